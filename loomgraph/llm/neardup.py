"""Operator 7: near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds the hashes of its distinct runs of *width* words; documents with equal sets
are one class, of which the smallest id goes on.  A class's signature has SYMBOLS symbols of 16 bits,
the lowest bits of that many minima.  Of two sets with similarity s, a symbol differs with
probability 1 - s, so all but a share MISS of the pairs at the threshold differ in at most *limit*
symbols, the binomial distribution's quantile, and pairs above the threshold in fewer.  There is one
limit for the first KEYED symbols and one for all of them, so a pair at the threshold is missed with a
probability of at most 2 * MISS, and one above it with less.

The first KEYED symbols are split into chunks so that their limit <= 2 * chunks - 1: by the pigeonhole
principle two signatures within the limit differ in at most one symbol of some chunk.  Each chunk's one
allowed error is enumerated by leaving out one of its symbols, so these classes share a key, for certain.
Classes that share a key are candidates only: signatures go along, and the number of differing
symbols decides.  First each key's smallest class is held against the others with that key; what
lies within the limit joins families.  Then the members of a key that are still in different
families are held against each other in tiles of bounded size.  So chance keys join nothing, no
bucket becomes pairs of rows, and every pair within the limit lies in one family.

Inside families the true sets decide, again in two steps.  Each class is held against its smallest
neighbour of the first step; the links that hold unite most of a family, each text moving once.
What is left are families with several components: blocks of one component meet the blocks of the
others in tiles (see ``_deal``), never those of their own, so united members are not compared again.
In a tile the sizes of all intersections come from the product of the block's incidence matrix, in
slices; of the confirmed links a spanning forest is passed on.  Its components are the result: no
link between different texts is lost, and none is emitted twice.

Shingles are 64-bit hashes, and two sets of n shingles are wrongly seen to share one with a
probability below n**2 / 2**64; sets are named by 128 bits.

Null or empty texts, and texts without words, have the empty set and are linked with nothing.  A text
of fewer words than *width* is one shingle.  Repeated rows have their id's component each; rows that
share an id but not the text are united by the id.  A null id is its own row with a null component.
An empty table gives no rows.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import components, shared, words

#: Symbols of a signature; its first KEYED ones make the keys.
SYMBOLS, KEYED = 128, 64
#: Share of the pairs exactly at the threshold whose signatures may differ in more symbols than the limit.
MISS = 1e-6
#: Shingles and documents of a block of a family, and signatures of a block of a bucket.
TILE, DOCUMENTS, BUCKET = 100_000, 400, 1000
#: Shingles of more sets of a tile than this are counted by a matrix of so many columns at a time.
RARE, COLUMNS = 24, 8192

_SEEDS = words.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_MULT = np.uint64(0xD6E8FEB86659FD93)
_M = np.uint64(0xBF58476D1CE4E5B9)


def limit_of(percent: int, miss: float = MISS, symbols: int = KEYED) -> int:
    """The fewest differing symbols that all but *miss* of the pairs at the threshold don't exceed."""
    p = 1 - percent / 100
    left = 1.0
    for k in range(symbols + 1):
        left -= comb(symbols, k) * p**k * (1 - p) ** (symbols - k)
        if left <= miss:
            return k
    return symbols


def chunks_of(limit: int, symbols: int = KEYED) -> list[np.ndarray]:
    """Symbol numbers of each chunk; at most one of a chunk differs in some chunk of any pair within *limit*."""
    n = min(symbols, limit // 2 + 1)
    return np.array_split(np.arange(symbols), n)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after another, and their offsets."""
    n = len(first) - 1
    count = np.diff(first)
    with np.errstate(over="ignore"):
        m = max(0, len(hashes) - width + 1)
        total = np.zeros(m, np.uint64)
        for k in range(width):
            total = total * _MULT + hashes[k : k + m]
        text = np.repeat(np.arange(n), count)[:m]
        good = np.arange(m) + width <= first[text + 1]
        total, text = words.mix(total[good]), text[good]
        short = np.flatnonzero((count > 0) & (count < width))
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            extra[has] = extra[has] * _MULT + hashes[first[short[has]] + k]
        extra = words.mix(extra + count[short].astype(np.uint64))
    total, text = np.concatenate([total, extra]), np.concatenate([text, short])
    order = np.lexsort((total, text))
    total, text = total[order], text[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    total, text = total[fresh], text[fresh]
    return total, np.searchsorted(text, np.arange(n + 1))


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16-bit symbols of every set that isn't empty, in order."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), SYMBOLS), np.uint16)
    if not len(starts):
        return out
    with np.errstate(over="ignore"):
        for k in range(SYMBOLS):
            x = sets * _SEEDS[k]
            x ^= x >> np.uint64(29)
            x *= _M
            out[:, k] = words.mix(np.minimum.reduceat(x, starts)).astype(np.uint16)
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of differing symbols of the rows of *a* and *b*, which are broadcast against each other."""
    return np.count_nonzero(a != b, axis=-1)


def keys_of(signature: np.ndarray, chunks: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of every signature: each chunk without each of its symbols in turn."""
    out = np.empty((len(signature), sum(len(c) for c in chunks)), np.uint64)
    with np.errstate(over="ignore"):
        at = 0
        for c in chunks:
            terms = words.mix(signature[:, c].astype(np.uint64) + (c.astype(np.uint64) + np.uint64(1)) * np.uint64(1 << 20))
            total = terms.sum(axis=1, dtype=np.uint64)
            for k in range(len(c)):
                out[:, at] = words.mix(total - terms[:, k] + np.uint64(at + 1) * _MULT)
                at += 1
    return out


def _digests(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set."""
    with np.errstate(over="ignore"):
        one, two = words.mix(sets ^ np.uint64(0x51ED270B)), words.mix(sets * _MULT + np.uint64(77))
        total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (one, two)]
        return tuple(words.mix(t[offsets[1:]] - t[offsets[:-1]]) for t in total)


class Forest:
    """Union-find over local numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def confirm(sets: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with 100 * intersection >= percent * union."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    if n == 2:
        both = len(np.intersect1d(sets[: size[0]], sets[size[0] :], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size[0] + size[1] - both) and both else []
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(sets, kind="stable")
    values, owner = sets[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    times = np.diff(np.append(begin, len(values)))
    both = np.zeros(n * n, np.float64)
    for m in np.unique(times[(times > 1) & (times <= RARE)]).tolist():  # shingles of m sets: all their pairs
        i, j = np.triu_indices(m, 1)
        rows = begin[times == m]
        for at in range(0, len(rows), step := max(1, 2_000_000 // len(i))):
            of = owner[rows[at : at + step, None] + np.arange(m)]
            both += np.bincount((of[:, i] * n + of[:, j]).ravel(), minlength=n * n)
    both = both.reshape(n, n)
    both += both.T
    often = np.flatnonzero(times > RARE)
    for at in range(0, len(often), COLUMNS):  # and of more: an incidence matrix
        chosen = often[at : at + COLUMNS]
        part = np.zeros((n, len(chosen)), np.float32)
        part[owner[words.ragged(begin[chosen], times[chosen])], np.repeat(np.arange(len(chosen)), times[chosen])] = 1
        both += part @ part.T
    union = size[:, None] + size[None, :] - both
    a, b = np.nonzero(np.triu((100 * both >= percent * union) & (both > 0), 1))
    forest = Forest(n)
    return [(x, y) for x, y in zip(a.tolist(), b.tolist()) if forest.join(x, y)]


def _profile(docs: DataFrame, width: int, limit: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (the set's name), signature (empty for an empty set), keys: one row for each document."""
    chunks = chunks_of(limit)

    def run(batches):
        for table in words.regroup(batches, "text", 4 << 20):
            _, _, hashes, first = words.split_words(*words.column_bytes(table["text"]))
            sets, offsets = shingle_sets(hashes, first, width)
            d1, d2 = _digests(sets, offsets)
            signature = signatures(sets, offsets)
            keys = keys_of(signature, chunks)
            full = np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
            yield pa.RecordBatch.from_pydict({
                "doc_id": table["doc_id"].combine_chunks(), "n_shingles": pa.array(np.diff(offsets), pa.int64()),
                "d1": pa.array(d1.view(np.int64)), "d2": pa.array(d2.view(np.int64)),
                "signature": pa.BinaryArray.from_buffers(pa.binary(), len(full) - 1, [None, pa.py_buffer((full * (2 * SYMBOLS)).astype(np.int32)), pa.py_buffer(signature.tobytes())]),
                "keys": pa.ListArray.from_arrays(pa.array(full * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
            })

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, signature binary, keys array<long>")


def _symbols(column: pa.Array) -> np.ndarray:
    data, _ = words.column_bytes(column)
    return np.ascontiguousarray(data).view(np.uint16).reshape(-1, SYMBOLS)


def _within(pairs: DataFrame, signed: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most *limit* symbols."""

    def run(batches):
        for batch in batches:
            keep = differing(_symbols(batch.column(2)), _symbols(batch.column(3))) <= limit
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda n: signed.select(F.col("doc_id").alias(n), F.col("signature").alias("_" + n))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def _deal(rows: DataFrame, group: str, own: str, name: str, weight: str) -> DataFrame:
    """Rows (tile, name) in which every two rows of a group with different *own* meet, and few others do.

    An *own* that weighs more than half a block is dealt into blocks of its own, by hash; lighter ones are
    pooled.  Every two blocks of a group make a tile, unless both are of one *own*; *weight* counts blocks.
    """
    per = rows.groupBy(group, own).agg(F.sum(weight).alias("w"))
    pool = per.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("w") <= 0.5, F.col("w")))).cast("int")).alias("pool"), F.max(F.col("w") <= 0.5).alias("pooled"))
    named = per.join(pool, group).withColumn("large", F.col("w") > 0.5).withColumn("n", F.when(F.col("large"), F.ceil("w")).otherwise(F.col("pool")).cast("int"))
    part = F.when(F.col("large"), F.xxhash64(name)).otherwise(F.xxhash64(own))
    block = F.struct(F.when(F.col("large"), F.col(own)).alias("of"), F.pmod(part, F.col("n")).cast("int").alias("h"))
    placed = rows.join(named.select(group, own, "large", "n"), [group, own]).select(group, name, block.alias("block"))
    every = F.explode(F.expr("transform(sequence(0, n - 1), h -> struct(of, h))"))
    blocks = named.filter("large").select(group, F.col(own).alias("of"), "n").unionByName(pool.filter("pooled").select(group, F.lit(None).cast("long").alias("of"), F.col("pool").alias("n")))
    blocks = blocks.select(group, every.alias("block"))
    both = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), group).filter("x <= y and (x.of is null or y.of is null or x.of <> y.of)")
    tiles = both.select(group, F.xxhash64(group, "x.of", "x.h", "y.of", "y.h").alias("tile"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    tiles = tiles.select(group, "tile", F.col("block.of").alias("of"), F.col("block.h").alias("h"))
    placed = placed.select(group, name, F.col("block.of").alias("of"), F.col("block.h").alias("h"))
    meet = [placed[group] == tiles[group], placed["of"].eqNullSafe(tiles["of"]), placed["h"] == tiles["h"]]
    return placed.join(tiles, meet).select("tile", placed[name])


def _by_tile(batches, column: int = 0):
    """Tables of the rows of a tile, from batches that are sorted by tile."""
    held, tile = [], None
    for batch in batches:
        key = batch.column(column).to_numpy()
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi <= lo:
                continue
            if held and key[lo] != tile:
                yield pa.Table.from_batches(held)
                held = []
            tile = key[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def near_roots(signature: np.ndarray, roots: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A forest of links between different roots that have signatures within *limit*."""
    names, of = np.unique(roots, return_inverse=True)
    if len(names) < 2:
        return []
    most = int(np.bincount(of).argmax())
    rest = np.flatnonzero(of != most)  # a pair of different roots has one of these
    forest, out = Forest(len(names)), []
    for at in range(0, len(rest), step := max(1, (8 << 20) // (len(signature) * SYMBOLS))):
        rows = rest[at : at + step]
        near = differing(signature[rows][:, None, :], signature[None, :, :]) <= limit
        a, b = np.nonzero(near & (of[rows][:, None] != of[None, :]))
        for x, y in np.unique(np.stack([of[rows[a]], of[b]], axis=1), axis=0).tolist():
            if forest.join(x, y):
                out.append((int(names[max(x, y)]), int(names[min(x, y)])))
    return out


def _crossing(members: DataFrame, rooted: DataFrame, signed: DataFrame, limit: int, bucket: int) -> DataFrame:
    """Links (a, b) of roots in different families that have members within *limit* in one bucket."""
    spark = members.sparkSession
    rows = members.join(rooted, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    several = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n")).filter("least <> most and n > 2")
    rows = shared.written(rows.join(several.select("key"), "key", "left_semi").withColumn("w", F.lit(1 / bucket)), "neardup-crossing")  # of two members the first step knows all

    def run(batches):
        out = []
        for table in _by_tile(batches):
            out += near_roots(_symbols(table["signature"]), table["root"].to_numpy(), limit)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    dealt = _deal(rows, "key", "root", "doc_id", "w").join(rooted, F.col("doc_id") == F.col("node"), "left").select("tile", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    dealt = dealt.join(signed.select("doc_id", "signature"), "doc_id").select("tile", "root", "signature")
    return dealt.repartition(shared.partitions(spark), "tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def stars(sets: np.ndarray, offsets: np.ndarray, lead: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The pairs (set, leading set) with 100 * intersection >= percent * union."""
    size, out = np.diff(offsets), []
    for x in np.flatnonzero(lead).tolist():
        own = sets[offsets[x] : offsets[x + 1]]
        at = np.minimum(np.searchsorted(own, sets), max(0, len(own) - 1))
        hit = np.concatenate([[0], np.cumsum(own[at] == sets)]) if len(own) else np.zeros(len(sets) + 1, np.int64)
        both = hit[offsets[1:]] - hit[offsets[:-1]]
        good = ~lead & (both > 0) & (100 * both >= percent * (size + size[x] - both))
        out += [(y, x) for y in np.flatnonzero(good).tolist()]
    return out


def _tiles(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of rows (tile, lead, doc_id, text): those of a leading row, or of all pairs where none leads."""
    spark = rows.sparkSession

    def links(held: list[pa.Table]):
        table = pa.concat_tables(held)
        ids, lead = table["doc_id"].to_numpy(), table["lead"].to_numpy()
        _, _, hashes, first = words.split_words(*words.column_bytes(table["text"]))
        sets, offsets = shingle_sets(hashes, first, width)
        at = 0
        for tile in held:
            own = slice(at, at + tile.num_rows + 1)
            part, cut = sets[offsets[own.start] : offsets[own.stop - 1]], offsets[own] - offsets[own.start]
            led = lead[at : at + tile.num_rows]
            found = stars(part, cut, led, percent) if led.any() else confirm(part, cut, percent)
            yield from ((int(ids[at + x]), int(ids[at + y])) for x, y in found)
            at += tile.num_rows

    def run(batches):
        held, have, out = [], 0, []
        for tile in _by_tile(batches):
            held.append(tile)
            have += tile["text"].nbytes
            if have > 4 << 20:  # several small tiles are split into words at once
                out += links(held)
                held, have = [], 0
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        if held:
            out += links(held)
        yield _edges(out)

    rows = rows.repartition(shared.partitions(spark), "tile").withColumn("h", F.xxhash64("text")).dropDuplicates(["tile", "lead", "doc_id", "h"])
    return rows.select("tile", "lead", "doc_id", "text").sortWithinPartitions("tile", "doc_id").mapInArrow(run, "a long, b long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})


def families(signed: DataFrame, limit: int, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, signature, keys): (node, root) of all classes within *limit* of another, and the first step's links (a, b), b < a."""
    keyed = signed.select("doc_id", F.explode("keys").alias("key"))
    low = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").drop("high")
    members = shared.written(keyed.join(low, "key").select("key", "doc_id", "low"), "neardup-buckets")
    near = members.filter("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct()
    near = shared.written(_within(near, signed, limit), "neardup-near")
    first = shared.written(components.connected(near), "neardup-first")
    crossing = shared.written(_crossing(members.select("key", "doc_id").distinct(), first, signed, limit, bucket), "neardup-cross")
    shared.dropped(members)
    if crossing.take(1):
        first = components.connected(near.unionByName(crossing))
    return first.unionByName(first.select(F.col("root").alias("node"), "root").distinct()), near


def groups(docs: DataFrame, width: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    shared.tune(spark)
    limit, far = limit_of(percent), limit_of(percent, symbols=SYMBOLS)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    profile = shared.written(_profile(plain, width, limit), "neardup-profile")
    full = profile.filter("n_shingles > 0 and doc_id is not null")

    # equal sets: the smallest id stands for the class
    same = ["n_shingles", "d1", "d2"]
    classes = shared.written(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "neardup-classes")
    copies = shared.written(full.select("doc_id", *same).join(classes, same).filter("doc_id <> rep"), "neardup-copies")
    signed = full.join(copies.drop("rep"), ["doc_id", *same], "left_anti").select("doc_id", "n_shingles", "signature", "keys")
    signed = shared.written(signed, "neardup-signed")  # read for the keys, and again for the signatures
    family, near = families(signed, far)
    family = shared.written(family, "neardup-families")
    sizes = profile.select(F.col("doc_id").alias("node"), "n_shingles").groupBy("node").agg(F.sum("n_shingles").alias("n_shingles"))
    weight = 1 / F.lit(DOCUMENTS) + F.col("n_shingles") / TILE

    # each class against its smallest neighbour, in blocks
    led = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("lead")).join(sizes, "node").withColumn("w", weight)
    blocks = led.groupBy("lead").agg(F.ceil(F.sum("w")).cast("int").alias("blocks"))
    tile = F.xxhash64("lead", "block").alias("tile")
    ours = led.join(blocks, "lead").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select(tile, F.lit(False).alias("lead"), F.col("node").alias("doc_id"))
    theirs = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(tile, F.lit(True).alias("lead"), F.col("lead").alias("doc_id"))
    links = shared.written(_tiles(plain.join(ours.unionByName(theirs), "doc_id"), width, percent), "neardup-links")

    # families that are still in several parts, of more than the two documents that have just met
    parts = components.connected(links).withColumnRenamed("root", "part")
    open_ = family.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = open_.groupBy("root").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high and n > 2")
    open_ = shared.written(open_.join(several.select("root"), "root", "left_semi").join(sizes, "node").withColumn("w", weight), "neardup-open")
    dealt = _deal(open_, "root", "part", "node", "w").select("tile", F.lit(False).alias("lead"), F.col("node").alias("doc_id"))
    more = shared.written(_tiles(plain.join(dealt, "doc_id"), width, percent), "neardup-links")

    links = links.unionByName(more).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    root = components.connected(links).select(F.col("node").alias("doc_id"), "root")
    out = profile.select("doc_id", "n_shingles").join(root, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
