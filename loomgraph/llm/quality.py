"""Operator 13: quality classifier, a generalised additive model with pairwise interactions.

Each text becomes numbers (``FEATURES``), each number a bin by quantiles of the training rows.  The model is an
intercept, a table of a value for each bin of each feature, and a table for each of a few pairs of features.  Tables are
learnt by cyclic boosting: round after round, one feature after another gets a shallow tree over its bins that is
fitted to the logistic loss's gradients and added, scaled by RATE, to its table.  With those fixed, the
pairs whose quadrants explain most of the remaining gradient are boosted likewise.  A score is the logistic
function of added table entries, looked up for whole batches.

Training takes at most SAMPLE labelled rows, those with the smallest hashes of their ids, and their numbers only go to
the driver (SAMPLE rows of float64); a text's length doesn't matter.  Scoring reads whole texts and shuffles nothing.

Null or empty text: the numbers of a text without words, so it gets a score like all others.  No labelled rows: every score is
0.5; labels of one class: all scores are their smoothed share.  Rows of an id that occurs several times, in either
table, count each.  Null labels and ids aren't learnt from.  An empty table gives no rows.  Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared, words

#: Labelled rows that are learnt from at most.
SAMPLE = 20_000
#: Bins of a feature, and of each side of a pair; rounds at most; share of a step; rounds without a gain that end learning; pairs.
BINS, PAIR_BINS, ROUNDS, RATE, PATIENCE, PAIRS = 48, 12, 300, 0.15, 15, 6
#: Least weight (sum of hessians) of a leaf, what is added to it, and cuts of a tree.
LEAST, SMOOTH, CUTS = 2.0, 1.0, 3
#: Texts are scored in chunks of this many bytes.
CHUNK = 4 << 20

FEATURES = (
    "letters", "upper", "digits", "symbols", "stops", "accents", "spaces", "log_words", "word_length", "word_spread", "longest_word", "distinct_words", "repeated_next",
    "capital_words", "symbol_words", "log_lines", "distinct_lines", "words_a_line", "words_a_stop",
)


def _classes() -> dict[str, np.ndarray]:
    of = lambda test: np.array([test(b) for b in range(256)], bool)
    ascii_ = lambda b: b < 128
    return {
        "letters": of(lambda b: b >= 128 or chr(b).isalpha()), "upper": of(lambda b: ascii_(b) and chr(b).isupper()), "digits": of(lambda b: ascii_(b) and chr(b).isdigit()),
        "symbols": of(lambda b: ascii_(b) and chr(b) in "#$%&*|@^~+=<>{}[]\\_`/"), "stops": of(lambda b: ascii_(b) and chr(b) in ".!?"),
        "accents": of(lambda b: b >= 0xC0), "spaces": of(lambda b: b in words.SPACES),
    }


_CLASSES = _classes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The numbers of each text, one row a text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out: dict[str, np.ndarray] = {}
    inside = {}
    for name, table in _CLASSES.items():
        inside[name] = table[data]
        sums = np.concatenate([[0], np.cumsum(inside[name], dtype=np.int64)])
        out[name] = np.diff(sums[offsets]) / np.maximum(size, 1)
    per = lambda sums, count: sums / np.maximum(count, 1)
    starts, ends, hashes, first = words.split_words(data, offsets)
    count = np.diff(first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(float)
    total = lambda x: np.bincount(doc, x, n)
    mean = per(total(length), count)
    out |= {"log_words": np.log1p(count), "word_length": mean, "word_spread": np.sqrt(np.maximum(per(total(length**2), count) - mean**2, 0))}
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    out["longest_word"] = np.log1p(longest)
    out["distinct_words"] = per(_distinct(doc, hashes, n), count)
    again = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out["repeated_next"] = per(np.bincount(doc[1:][again], minlength=n), count)
    out["capital_words"] = per(total(inside["upper"][starts].astype(float)), count) if len(starts) else np.zeros(n)
    marks = np.concatenate([[0], np.cumsum(inside["symbols"], dtype=np.int64)])
    out["symbol_words"] = per(total((marks[ends] > marks[starts]).astype(float)), count)
    _, _, lines, first_line = words.split_words(data, offsets, b"\n", fold=False)
    line_count = np.diff(first_line).astype(float)
    line_doc = np.repeat(np.arange(n), np.diff(first_line))
    out |= {"log_lines": np.log1p(line_count), "distinct_lines": per(_distinct(line_doc, lines, n), line_count), "words_a_line": per(count, line_count)}
    out["words_a_stop"] = np.log1p(per(count, out["stops"] * size))
    return np.stack([out[name] for name in FEATURES], 1) if n else np.empty((0, len(FEATURES)))


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.bincount(d[new], minlength=n).astype(float)


@dataclass
class Model:
    """Edges of the bins, and what each bin, or pair of bins, adds."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logit(x))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray | float, h: np.ndarray | float):
    return g * g / (h + SMOOTH)


def tree(g: np.ndarray, h: np.ndarray, cuts: int = CUTS) -> np.ndarray:
    """The value of each bin of a tree over bins in order, grown by its best cuts; *g*, *h*: sums of gradients and hessians."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(cuts):
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            lg, lh, rg, rh = cg[at] - cg[a], ch[at] - ch[a], cg[b] - cg[at], ch[b] - ch[at]
            gain = np.where((lh >= LEAST) & (rh >= LEAST), _leaf(lg, lh) + _leaf(rg, rh) - _leaf(cg[b] - cg[a], ch[b] - ch[a]), 0)
            top = int(np.argmax(gain))
            if gain[top] > best[0]:
                best = (gain[top], k, int(at[top]))
        if not best[2]:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + SMOOTH)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """The best gain of one cut on each side of a pair, and the two cuts; *g*, *h*: sums by both bins."""
    total_g, total_h = g.sum(), h.sum()
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, 0, 0
    a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
    b_g, b_h = cg[:-1, -1:] - a_g, ch[:-1, -1:] - a_h
    c_g, c_h = cg[-1:, :-1] - a_g, ch[-1:, :-1] - a_h
    d_g, d_h = total_g - a_g - b_g - c_g, total_h - a_h - b_h - c_h
    gain = _leaf(a_g, a_h) + _leaf(b_g, b_h) + _leaf(c_g, c_h) + _leaf(d_g, d_h) - _leaf(total_g, total_h)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[i, j]), int(i) + 1, int(j) + 1


def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree with one cut on each side."""
    gain, i, j = quadrants(g, h)
    out = np.zeros(g.shape)
    if gain > 1e-9:
        for rows in (slice(0, i), slice(i, None)):
            for columns in (slice(0, j), slice(j, None)):
                out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + SMOOTH)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of rows of numbers and their labels (0, 1); every eighth row tells when to stop."""
    if not len(y):
        return Model()
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(intercept=float(np.log(share / (1 - share))))
    if y.min() == y.max() or len(y) < 16:
        return model
    check = np.arange(len(y)) % 8 == 7
    model.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    model.pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    z = np.full(len(y), model.intercept)
    grow = lambda k, g, h: tree(np.bincount(bins[k], g, len(model.tables[k])), np.bincount(bins[k], h, len(model.tables[k])))
    _boost(model.tables, lambda k, step: step[bins[k]], grow, z, y, check)
    sides = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.pair_edges)]
    p = _logistic(z)
    g, h = np.where(check, 0, y - p), np.where(check, 0, p * (1 - p))
    found = []
    for i, j in combinations(range(x.shape[1]), 2):
        shape = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        code = sides[i] * shape[1] + sides[j]
        found.append((-quadrants(np.bincount(code, g, shape[0] * shape[1]).reshape(shape), np.bincount(code, h, shape[0] * shape[1]).reshape(shape))[0], i, j, code, shape))
    chosen = sorted(found, key=lambda f: f[:3])[:PAIRS]
    tables = [np.zeros(shape) for *_, shape in chosen]

    def grow_pair(k, g, h):
        code, shape = chosen[k][3:]
        return pair_tree(np.bincount(code, g, shape[0] * shape[1]).reshape(shape), np.bincount(code, h, shape[0] * shape[1]).reshape(shape))

    _boost(tables, lambda k, step: step.ravel()[chosen[k][3]], grow_pair, z, y, check)
    model.pairs = [(i, j, table) for (_, i, j, _, _), table in zip(chosen, tables)]
    for k, table in enumerate(model.tables):  # tables have mean 0 over the training rows
        mean = float(table[bins[k]].mean())
        table -= mean
        model.intercept += mean
    return model


def _boost(tables: list[np.ndarray], at, grow, z: np.ndarray, y: np.ndarray, check: np.ndarray) -> None:
    """Cyclic boosting of *tables* in place, and of the rows' logits *z*, back to the round that the checked rows liked best."""
    loss = lambda: float(np.mean(np.logaddexp(0, np.where(y[check] == 1, -z[check], z[check]))))
    best, kept, kept_z, waited = loss(), [t.copy() for t in tables], z.copy(), 0
    for _ in range(ROUNDS):
        for k in range(len(tables)):
            p = _logistic(z)
            step = RATE * grow(k, np.where(check, 0, y - p), np.where(check, 0, p * (1 - p)))
            tables[k] += step
            z += at(k, step)
        now = loss()
        if now < best - 1e-7:
            best, kept, kept_z, waited = now, [t.copy() for t in tables], z.copy(), 0
        else:
            waited += 1
            if waited >= PATIENCE:
                break
    for table, old in zip(tables, kept):
        table[...] = old
    z[...] = kept_z


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of the documents (doc_id, text) that *labels* (doc_id, *label*: 0, 1) marks."""
    order = lambda *more: (F.xxhash64(F.col("doc_id").cast("string")), "doc_id", *more)
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    known = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = marked.join(known.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*order("label")).limit(sample)  # at most *sample* small rows: a bounded broadcast
    rows = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    numbers = _numbers(rows, ["doc_id", "label"]).orderBy(*order("label", "numbers")).limit(sample).collect()
    x = np.array([r["numbers"] for r in numbers], float).reshape(len(numbers), len(FEATURES))
    return fit(x, np.array([r["label"] for r in numbers], np.int64))


def _numbers(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Columns *keep* and numbers (an array) of rows with text."""
    shared.tune(rows.sparkSession)

    def run(parts):
        for table in words.regroup(parts, "text", CHUNK):
            x = features(*words.column_bytes(table.column("text")))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield from pa.Table.from_arrays([table.column(c) for c in keep] + [flat], [*keep, "numbers"]).to_batches()

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "text").mapInArrow(run, f"{kept}, numbers array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) of all documents."""
    spark = docs.sparkSession
    shared.tune(spark)
    held = spark.sparkContext.broadcast(model)

    def run(parts):
        for table in words.regroup(parts, "text", CHUNK):
            found = held.value.score(features(*words.column_bytes(table.column("text"))))
            yield from pa.Table.from_arrays([table.column("doc_id"), pa.array(found)], ["doc_id", "score"]).to_batches()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def in_test(key: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether a row is held out: crc32 of the id as text, modulo *folds*, is *fold*; a null id isn't."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))
