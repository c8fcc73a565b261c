"""Operator 2: benchmark decontamination by greedy string tiling.

Texts are lower-cased words of letters and digits.  Seeds are the hashes of MIN_MATCH consecutive
words that a document shares with a benchmark item.  For every pair with a seed, running
Karp-Rabin fingerprints extend the seeds to maximal common runs; the longest run is marked again
and again, leaving out words that are marked already, until no run of MIN_MATCH words is left
(running Karp-Rabin greedy string tiling).  The share of the item's words that are marked is its
coverage, which does not depend on the order of the passages; a pair with THRESHOLD or more is
contaminated.

The benchmark's seed index is broadcast if its texts hold at most INDEX_BYTES; the documents are
then read once without a shuffle.  A larger benchmark is joined on the seeds by a shuffle, and
tiling runs on the joined pairs.  Both give the same rows.

An item of fewer than MIN_MATCH words is matched as a whole: its runs have all its words.  Null or empty
texts, and items without a word, match nothing.  Repeated rows are
each reported.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import shared, words

MIN_MATCH, THRESHOLD = 5, 0.8
#: Largest benchmark whose index is broadcast.
INDEX_BYTES = 64 << 20

_SPACES = bytes(b for b in range(128) if not chr(b).isalnum())
_P = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 20) - 1)
_TILE = "array<struct<doc_start:int,item_start:int,words:int>>"
PAIRS = f"doc_id long, item_id long, item_words int, covered int, coverage double, n_tiles int, tiles {_TILE}, row_key long"


def seeds(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every *n* consecutive words of a text."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * _P + hashes[k : len(hashes) - n + 1 + k]
    text = np.searchsorted(first, np.arange(len(total)), side="right") - 1
    good = np.arange(len(total)) + n <= first[text + 1]
    total = words.mix(total)
    return total, np.where(good, text, -1)


def _prints(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """Running Karp-Rabin: fingerprints of all prefixes, and the powers, modulo 2^61 - 1."""
    mod, base = (1 << 61) - 1, 0x5851F42D4C957F2D % ((1 << 61) - 1)
    prints, powers = [0], [1]
    for h in hashes.tolist():
        prints.append((prints[-1] * base + h) % mod)
        powers.append(powers[-1] * base % mod)
    return prints, powers


def tile(doc: np.ndarray, item: np.ndarray, starts: list[tuple[int, int]], n: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (doc_start, item_start, words) of two word sequences, from the seeds' (doc, item) positions."""
    mod = (1 << 61) - 1
    lo, hi = min(d for d, _ in starts), max(d for d, _ in starts)
    lo, hi = max(0, lo - len(item)), min(len(doc), hi + n + len(item))  # a run lies within an item's length of its seeds
    (dp, powers), (ip, more) = _prints(doc[lo:hi]), _prints(item)
    powers = powers if len(powers) >= len(more) else more
    part = lambda p, at, k: (p[at + k] - p[at] * powers[k]) % mod
    seen = set(starts)
    heap = []
    for d, i in starts:
        if (d - 1, i - 1) in seen:
            continue  # not the run's first seed
        low, high = n, min(hi - d, len(item) - i)
        while low < high:  # longest common run by bisection on fingerprints
            mid = (low + high + 1) // 2
            if part(dp, d - lo, mid) == part(ip, i, mid):
                low = mid
            else:
                high = mid - 1
        heap.append((-low, d, i))
    heapq.heapify(heap)
    in_doc, in_item = set(), np.zeros(len(item), bool)
    tiles = []
    while heap:
        size, d, i = heapq.heappop(heap)
        run, at, whole = -size, 0, True
        while at < run:  # what is left of the run beside words that are marked
            while at < run and (in_item[i + at] or d + at in in_doc):
                at, whole = at + 1, False
            begin = at
            while at < run and not (in_item[i + at] or d + at in in_doc):
                at += 1
            if begin == 0 and at == run:
                break
            whole = False
            if at - begin >= n:
                heapq.heappush(heap, (begin - at, d + begin, i + begin))
        if whole and run >= n:
            tiles.append((d, i, run))
            in_item[i : i + run] = True
            in_doc.update(range(d, d + run))
    return sorted(tiles)


class Index:
    """Seeds of a set of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], n: int = MIN_MATCH):
        data, offsets = words.column_bytes(pa.array(texts, pa.large_string()))
        _, _, self.hashes, self.first = words.split_words(data, offsets, _SPACES)
        self.ids, self.n = ids, n
        size = np.diff(self.first)
        self.parts = []  # by run length: seeds, items, places, and a table of the seeds' low bits
        for m in range(1, n + 1):
            seed, item = seeds(self.hashes, self.first, m)
            keep = item >= 0
            keep[keep] = np.minimum(size[item[keep]], n) == m
            if not keep.any():
                continue
            where = np.flatnonzero(keep) - self.first[item[keep]]
            order = np.argsort(seed[keep], kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(seed[keep] & _LOW).astype(np.int64)] = True
            self.parts.append((m, seed[keep][order], item[keep][order], where[order], bits))

    def pairs(self, texts: pa.Array, threshold: float):
        """(text number, item number, words of the item, tiles) of the contaminated pairs."""
        data, offsets = words.column_bytes(texts)
        _, _, hashes, first = words.split_words(data, offsets, _SPACES)
        for part in self.parts:
            yield from self._pairs(hashes, first, part, threshold)

    def _pairs(self, hashes: np.ndarray, first: np.ndarray, part: tuple, threshold: float):
        n, known, items, places, bits = part
        seed, text = seeds(hashes, first, n)
        at = np.flatnonzero(bits[(seed & _LOW).astype(np.int64)] & (text >= 0))
        lo, hi = np.searchsorted(known, seed[at], "left"), np.searchsorted(known, seed[at], "right")
        at, lo, count = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        hit, d = words.ragged(lo, count), np.repeat(at, count)
        doc, item, where = text[d], items[hit], places[hit]
        order = np.lexsort((where, d, item, doc))
        doc, item, where, d = doc[order], item[order], where[order], d[order]
        cut = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(item, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)]):
            t, i = int(doc[a]), int(item[a])
            own = self.hashes[self.first[i] : self.first[i + 1]]
            # a word is covered only if a seed covers it
            reach = np.unique(where[a:b])
            could = int(np.minimum(np.diff(reach), n).sum()) + n
            if could < threshold * len(own):
                continue
            starts = list(zip((d[a:b] - first[t]).tolist(), where[a:b].tolist()))
            tiles = tile(hashes[first[t] : first[t + 1]], own, starts, n)
            if sum(x[2] for x in tiles) >= threshold * len(own):
                yield t, i, len(own), tiles


def _batch(doc_ids: list, keys: list, found, item_ids: list) -> pa.RecordBatch:
    rows = []
    for t, i, n, tiles in found:
        covered = sum(x[2] for x in tiles)
        rows.append((doc_ids[t], item_ids[i], n, covered, covered / n, len(tiles), [dict(zip(("doc_start", "item_start", "words"), x)) for x in tiles], keys[t]))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())])), pa.int64()]
    names = ["doc_id", "item_id", "item_words", "covered", "coverage", "n_tiles", "tiles", "row_key"]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _lower(df: DataFrame, text: str):
    return F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _small(benchmark: DataFrame, item_text: str, index_bytes: int) -> bool:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0)) + 64 * F.count(F.lit(1))).first()[0]
    return size <= index_bytes


def _broadcast(benchmark: DataFrame, item_id: str, item_text: str, n: int):
    rows = benchmark.select(F.col(item_id).cast("long"), _lower(benchmark, item_text)).collect()  # at most INDEX_BYTES
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    return benchmark.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], n))


def find(docs: DataFrame, benchmark: DataFrame, n: int = MIN_MATCH, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES,
         doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each contaminated pair, with its tiles in words."""
    spark = docs.sparkSession
    shared.tune(spark)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), _lower(docs, text).alias("text"))
    if _small(benchmark, item_text, index_bytes):
        held = _broadcast(benchmark, item_id, item_text, n)

        def scan(batches):
            for batch in batches:
                yield _batch(batch.column(0).to_pylist(), batch.column(1).to_pylist(), held.value.pairs(batch.column(2), threshold), held.value.ids)

        return keyed.mapInArrow(scan, PAIRS)

    keyed = shared.written(keyed, "decontaminate-docs")
    items = benchmark.select(F.col(item_id).cast("long").alias("key"), F.monotonically_increasing_id().alias("row_key"), _lower(benchmark, item_text).alias("text"))
    items = shared.written(items, "decontaminate-items")

    def grams(whole: bool):
        """Each text's distinct seeds of every length (of an item: of its own length), with the seed's places and the text's words."""

        def run(batches):
            for batch in batches:
                key = batch.column(0).to_numpy()
                _, _, hashes, first = words.split_words(*words.column_bytes(batch.column(1)), _SPACES)
                size = np.diff(first)
                for m in range(1, n + 1):
                    seed, of = seeds(hashes, first, m)
                    keep = of >= 0
                    if not whole:
                        keep[keep] = np.minimum(size[of[keep]], n) == m
                    both, times = np.unique(np.stack([of[keep].astype(np.uint64), seed[keep]], axis=1), axis=0, return_counts=True)
                    of_ = both[:, 0].astype(np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array(key[of_]), "m": pa.array(np.full(len(of_), m, np.int32)), "seed": pa.array(both[:, 1].view(np.int64)),
                        "places": pa.array(times, pa.int64()), "size": pa.array(size[of_], pa.int64()),
                    })

        return run

    theirs = shared.written(items.select("row_key", "text").mapInArrow(grams(False), "item_key long, m int, seed long, places long, size long"), "decontaminate-seeds")
    ours = keyed.select("row_key", "text").mapInArrow(grams(True), "doc_key long, m int, seed long, places long, size long").select("doc_key", "m", "seed")
    # a place covers m words at most: pairs that can't reach the threshold go before any text is joined, by partial sums
    shared_seeds = ours.join(theirs, ["m", "seed"]).groupBy("doc_key", "item_key").agg(F.sum(F.col("places") * F.col("m")).alias("could"), F.first("size").alias("size"))
    pairs = shared_seeds.filter(F.col("could") >= threshold * F.col("size")).select("doc_key", "item_key")
    pairs = pairs.join(items.select(F.col("row_key").alias("item_key"), F.col("key").alias("item_id"), F.col("text").alias("item_text")), "item_key")
    pairs = pairs.join(keyed.withColumnRenamed("row_key", "doc_key"), "doc_key").select("doc_id", "doc_key", "text", "item_id", "item_text")

    def tiled(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i in range(batch.num_rows):
                index = Index([columns[3][i]], [columns[4][i]], n)
                yield _batch([columns[0][i]], [columns[1][i]], index.pairs(batch.column(2).slice(i, 1), threshold), index.ids)

    return pairs.mapInArrow(tiled, PAIRS)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = MIN_MATCH, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES,
          text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that no benchmark item contaminates, as they are."""
    spark = docs.sparkSession
    shared.tune(spark)
    if not _small(benchmark, item_text, index_bytes):
        names = [F.col(f"`{c}`") for c in docs.columns]
        stored = shared.written(docs.select(F.struct(*names).alias("_row"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("doc_id")), "decontaminate-rows")
        bad = find(stored, benchmark, n, threshold, index_bytes, item_id=item_id, item_text=item_text).select("doc_id").distinct()
        return stored.join(bad, "doc_id", "left_anti").select("_row.*")
    held = _broadcast(benchmark, item_id, item_text, n)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _lower(docs, text).alias("text"))

    def keep(batches):
        for batch in batches:
            bad = {t for t, _, _, _ in held.value.pairs(batch.column(1), threshold)}
            mask = pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["row"]).filter(mask)

    return rows.mapInArrow(keep, T.StructType([rows.schema["row"]])).select("row.*")
