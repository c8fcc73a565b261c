"""Operator 11: spelling variants, by PartEnum signatures of letter multisets.

A word is the binary vector of its letters' occurrences (the second ``e`` is another dimension than the first).
One inserted or deleted letter changes one dimension, a replaced one two, so near words lie within a Hamming
distance of 1 if their lengths differ and of 2 if not.  PartEnum deals the dimensions to *parts* partitions and
enumerates every choice of partitions that may hold the differences; the letters of all the others are an exact
signature that two vectors within the distance share for at least one choice.  A single edit also leaves
one half of the word as it is, before it or after it, so a signature is told for either half and the length:
anagrams don't meet.  Words with equal signatures are equi-joined and verified by their edit distance.

Counts, signatures, joins and verification are JVM expressions.  Occurrences are counted with partial sums before
they are shuffled; after that there is one row for each distinct word, so no word is hot.

Null text: no words.  Null doc_id: named as the empty text in the hash.  Repeated rows count each.  Other columns of
the documents aren't read.  An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared

#: Runs of letters; lower case touches only A-Z.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter.
DAMAGED = 97
#: Least code points of a word, least occurrences, and how often a form must occur for each occurrence of its variant.
LENGTH, OCCURRENCES, RATIO = 5, 3, 2
#: Partitions of the dimensions for distance 2 (words of one length) and 1.
PARTS_SAME, PARTS_DIFF = 4, 2


def runs(docs: DataFrame) -> DataFrame:
    """A row (word) for each run of letters in the texts, one in DAMAGED without one of its letters, chosen by a hash of document and run."""
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run"))
    rows = rows.select("_run", h.alias("_h"), F.length("_run").alias("_n"))
    at = (F.col("_h") % F.col("_n")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.col("_n")))
    return rows.select(F.when(F.col("_h") % DAMAGED == 0, cut).otherwise(F.col("_run")).alias("word"))


def vocabulary(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """Rows (word, n) of the words that are long and frequent enough."""
    counted = runs(docs).filter(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= occurrences)


def _dealt(parts: int):
    return lambda e: F.struct(e.alias("e"), F.pmod(F.xxhash64(e), F.lit(parts)).alias("p"))


def _outside(left: tuple[int, ...]):
    return lambda x: ~x.p.isin(*left)


def _kept(parts: int, distance: int) -> list[Column]:
    """For each choice of *distance* partitions to leave out, the dimensions of the others."""
    placed = F.col(f"_placed{parts}")
    return [F.array_join(F.transform(F.filter(placed, _outside(left)), lambda x: x.e), "") for left in combinations(range(parts), distance)]


def signatures(words: DataFrame, parts_same: int = PARTS_SAME, parts_diff: int = PARTS_DIFF) -> DataFrame:
    """Rows (word, n, role, sig): role 0 meets words of its length, role 1 words that are one longer, which have role 2.

    A signature hashes the kept dimensions, the shorter word's length, and either its first half or its last.
    """
    letters = words.select("word", "n", F.length("word").alias("_size"), F.array_sort(F.split("word", "")).alias("_letters"))
    dimensions = F.transform("_letters", lambda c, i: F.concat(c, (i - F.array_position("_letters", c)).cast("string")))
    rows = letters.withColumn("_dimensions", dimensions)
    for parts in {parts_same, parts_diff}:
        rows = rows.withColumn(f"_placed{parts}", F.transform("_dimensions", _dealt(parts)))
    same, diff = _kept(parts_same, 2), _kept(parts_diff, 1)
    rows = rows.withColumns({f"_s{i}": c for i, c in enumerate(same)} | {f"_d{i}": c for i, c in enumerate(diff)})
    out = []
    for role, name, n in ((0, "_s", len(same)), (1, "_d", len(diff)), (2, "_d", len(diff))):
        base = F.col("_size") - (1 if role == 2 else 0)
        half = F.floor(base / 2).cast("int")
        sides = F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.col("_size") - (base - half) + 1, F.col("_size"))
        for side, text in enumerate(sides):
            out += [F.struct(F.lit(role).alias("role"), F.xxhash64(F.lit(f"{name}{i}/{side}"), base, text, F.col(f"{name}{i}")).alias("sig")) for i in range(n)]
    return rows.select("word", "n", F.explode(F.array(*out)).alias("_x")).select("word", "n", "_x.role", "_x.sig")


def near(words: DataFrame, parts_same: int = PARTS_SAME, parts_diff: int = PARTS_DIFF) -> DataFrame:
    """Rows (a, a_n, b, b_n) of all pairs of *words* (word, n; distinct) that differ by one inserted, deleted or replaced code point, either way round."""
    rows = signatures(words, parts_same, parts_diff)
    a, b = rows.alias("a"), rows.alias("b")
    meet = (F.col("a.sig") == F.col("b.sig")) & ((F.col("a.role") == 0) & (F.col("b.role") == 0) & (F.col("a.word") < F.col("b.word")) | (F.col("a.role") == 1) & (F.col("b.role") == 2))
    close = F.levenshtein("a.word", "b.word", 1) == 1
    found = a.join(b.hint("shuffle_merge"), meet & close).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))
    ends = F.array(F.struct("a", "a_n", "b", "b_n"), F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    return found.distinct().select(F.explode(ends).alias("x")).select("x.*")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of all *words* (word, n)."""
    words = shared.written(words, "words")
    best = F.min(F.struct((-F.col("b_n")).alias("least"), F.col("b").alias("form")))
    linked = near(words).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(linked, "word", "left").withColumn("form_n", -F.col("best.least"))
    good = F.col("form_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    rows = shared.written(rows, "variants")
    shared.dropped(words)
    roots = _roots(rows.filter("form is not null").select("word", F.col("form").alias("root")))
    out = rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """The end of each word's chain of forms, by doubling: counts grow by the ratio along a chain, so there is no cycle and rounds are few."""
    now = shared.written(steps, "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("_moved"))
        new = shared.written(moved, "roots")
        shared.dropped(now)
        now = new.drop("_moved")
        now._loomgraph_path = new._loomgraph_path
        if not new.filter("_moved").take(1):
            return now
