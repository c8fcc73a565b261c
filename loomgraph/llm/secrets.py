"""Operator 1: secret scans with multipart credential linking, in DataFrame functions only.

Strong spans stand alone: assignments of secrets, access identifiers and long hexadecimal strings.
Weak candidates (a login name, a bare 40-character token, a URL) are common in clean text, so they
are reported only if complementary parts of a credential lie in the same scope: a login needs a
secret, a bare token needs an identifier, and a URL needs both.  A part's scope is its own span
widened by SCOPE code points on both sides; parts are linked if one's span meets the other's scope.

This interval join makes no pairs: over a document's parts in order of their start, the latest end
so far and the next start from here on, of each role, decide whether a partner exists.  Only the
parts of documents with weak candidates are shuffled; a partition key is one document.

Spans are code points, end exclusive.  Positions come from the matches and the texts between them:
the lengths are summed in blocks of the square root of their number, so that a text with very many
matches stays cheap.  Null text is empty and has no spans.  Each repeated row has its own result.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm import shared

#: Code points around a span in which complementary parts count.
SCOPE = 200

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a least length in the pattern drops just the shorter matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LOGIN = r"""(?i:username|user_?id|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
TOKEN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_.=-])"
URL = r"""(?i:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+"""

#: Kinds in the order in which spans with equal starts are listed, with role and whether strong.
KINDS = [("assign", "secret", True), ("access", "id", True), ("hex", "secret", True), ("login", "id", False), ("token", "secret", False), ("url", "endpoint", False)]
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _let(name: str, value: str, body: str) -> str:
    """SQL for *body* with *name* standing for *value*, which is evaluated once (a projection may be inlined into lambdas)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _spans(could: Column, kind: int, pattern: str, least: int | None = None) -> Column:
    """The pattern's leftmost non-overlapping matches in _text; *could* is false only where there are none."""
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    size = "(x.gap + x.len)"
    lengths = "transform(m, (x, i) -> struct(cast(length(g[i]) as bigint) as gap, cast(length(x) as bigint) as len))"
    block = "cast(ceil(sqrt(size(l))) as int)"
    sums = f"transform(sequence(0, (size(l) - 1) div b), c -> aggregate(slice(l, cast(c * b + 1 as int), b), 0L, (a, x) -> a + {size}))"
    bases = "transform(t, (x, c) -> aggregate(slice(t, 1, c), 0L, (a, y) -> a + y))"
    start = f"s[cast(i div b as int)] + aggregate(slice(l, cast(i div b as int) * b + 1, cast(i % b as int)), 0L, (a, x) -> a + {size}) + y.gap"
    spans = "transform(transform(l, (y, i) -> struct(" + start + f" as start, y.len as len)), z -> struct(z.start as start, {kind} as kind, z.start + z.len as end))"
    if least is not None:
        value = f"regexp_extract_all(_text, {quoted}, 2)"
        spans = _let("v", value, f"filter({spans}, (q, i) -> length(v[i]) >= {least})")
    body = _let("b", block, _let("t", sums, _let("s", bases, spans)))
    body = _let("m", f"regexp_extract_all(_text, {quoted}, 0)", _let("g", f"split(_text, {quoted}, -1)", _let("l", lengths, f"if(size(l) = 0, cast(array() as {_SPAN}), {body})")))
    return F.when(could, F.expr(body).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds _text (null as empty), base (strong spans) and weak (candidates that meet no strong span), sorted."""
    df = docs.withColumn("_text", F.coalesce(F.col(text_column), F.lit("")))
    text = F.col("_text")
    df = df.withColumns({
        "s0": _spans(text.rlike(ASSIGN), 0, ASSIGN, least=6), "s1": _spans(text.contains("AKIA"), 1, ACCESS), "s2": _spans(text.rlike(HEX), 2, HEX),
        "s3": _spans(text.rlike(LOGIN), 3, LOGIN), "s4": _spans(text.rlike(TOKEN), 4, TOKEN), "s5": _spans(text.contains("://"), 5, URL),
    })
    df = df.withColumn("base", F.array_sort(F.concat("s0", "s1", "s2"))).withColumn("weak", F.concat("s3", "s4", "s5"))
    return df.drop("s0", "s1", "s2", "s3", "s4", "s5")


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Of rows with row_key, base and weak: row_key and linked, the weak spans that are reported."""
    number = {name: i for i, (name, _, _) in enumerate(KINDS)}
    ids = F.col("kind").isin(number["access"], number["login"])
    secret = F.col("kind").isin(number["assign"], number["hex"], number["token"])
    parts = scanned.filter(F.size("weak") > 0).select("row_key", F.explode(F.concat("base", "weak")).alias("p")).select("row_key", "p.*")
    order = [F.col(c) for c in ("start", "end", "kind")]
    key = W.partitionBy("row_key")
    before = key.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = key.orderBy(*[c.desc() for c in order]).rowsBetween(W.unboundedPreceding, -1)  # running on from the end, so linear

    def near(role: Column) -> Column:
        left = F.max(F.when(role, F.col("end"))).over(before) >= F.col("start") - scope
        right = F.min(F.when(role, F.col("start"))).over(after) <= F.col("end") + scope
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    strong = F.col("kind") <= number["hex"]
    met = F.coalesce(F.max(F.when(strong, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    parts = parts.select("*", near(ids).alias("has_id"), near(secret).alias("has_secret"), met.alias("met"))
    told = (
        (F.col("kind") == number["login"]) & F.col("has_secret")
        | (F.col("kind") == number["token"]) & F.col("has_id")
        | (F.col("kind") == number["url"]) & F.col("has_id") & F.col("has_secret")
    )
    return parts.filter(told & ~F.col("met")).groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{name}'" for name, _, _ in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    kept = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("_raw"))
    found = scan(kept, "_raw").select("doc_id", "base", "weak", F.monotonically_increasing_id().alias("row_key"))
    found = shared.written(found, "secret-parts")  # narrow: no texts; read twice, and row_key stays as it is
    out = found.join(link(found, scope), "row_key", "left")
    out = out.withColumn("linked", F.coalesce("linked", F.array().cast(_SPAN))).withColumn("all", F.array_sort(F.concat("base", "linked")))
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("`all`").alias("spans"), F.size("linked").cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]", scope: int = SCOPE, flag: str | None = None) -> DataFrame:
    """The documents with every reported span replaced by *mark*; overlapping spans by one mark; null text stays null.

    flag: name of a column to add, whether the text has changed.
    """
    names = docs.columns
    found = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text_column}`").alias("_raw")), "_raw")
    found = shared.written(found.select("_row", "base", "weak", F.monotonically_increasing_id().alias("row_key")), "secret-docs")
    linked = link(found, scope)
    spans = found.filter(F.size("base") > 0).select("row_key", F.explode("base").alias("s")).unionByName(linked.select("row_key", F.explode("linked").alias("s")))
    spans = spans.select("row_key", "s.start", "s.end")
    order = W.partitionBy("row_key").orderBy("start", "end")
    fresh = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    spans = spans.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = spans.groupBy("row_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    touched = found.filter((F.size("base") > 0) | (F.size("weak") > 0)).select("row_key", "_row").join(runs, "row_key", "left")
    text = f"_row.`{text_column}`"
    cut = F.expr(
        f"concat(array_join(transform(runs, (r, i) -> concat(substring({text}, cast(if(i > 0, runs[i - 1].end, 0) + 1 as int), cast(r.start - if(i > 0, runs[i - 1].end, 0) as int)), '{mark}')), ''), "
        f"substring({text}, cast(runs[size(runs) - 1].end + 1 as int)))"
    )
    changed = touched.withColumn("_changed", F.col("runs").isNotNull()).withColumn("_text", F.when(F.col("runs").isNotNull(), cut).otherwise(F.col(text)))
    clean = found.filter((F.size("base") == 0) & (F.size("weak") == 0)).select("_row", F.col(text).alias("_text"), F.lit(False).alias("_changed"))
    both = clean.unionByName(changed.select("_row", "_text", "_changed"))
    out = [F.col("_text").alias(c) if c == text_column else F.col(f"_row.`{c}`").alias(c) for c in names]
    return both.select(*out, *([F.col("_changed").alias(flag)] if flag else []))
