"""Operator 6: chroma audio fingerprints, and groups of recordings that match.

A recording is a row of 8-bit samples at 8 kHz.  Frames of FRAME samples every HOP are correlated with three
octaves of twelve pitches; a frame's pitch classes are smoothed over five frames and scaled to whole numbers.
Sixteen filters over an integral image of 16 frames give two bits each (Gray code), one packed integer for each
place.  Everything before the thresholds is whole or done element by element, so equal samples give equal integers.
A recording of fewer than LEAST samples is played over and over until it has LEAST, so each one that isn't empty has VOTES integers.

Two recordings match at an offset where at least VOTES of their integers are equal, the overlap is at least half
of the shorter one, and on average no more than ERRORS of 32 bits differ in the overlap.  Every offset with so many
votes is checked.  Groups are the components of the matches; recordings with equal integers are one from the start, and empty
ones stand alone.  Each recording of a group is aligned with another one of it: by the confirmed match that has the fewest bit
errors for its overlap, at the best of the match's offsets.

A first pass votes only with each value's smallest and largest recording; what it confirms is a match, and united
recordings leave the quadratic part.  The second pass compares all recordings of different groups that share a value.
Either all the integers that meet at an offset are of values with few occurrences: then the pairs of these are counted
as votes.  Or one of them is of a value with more: then a task that holds the integers of two blocks of that value's
recordings checks every offset at which it meets, and tells only the matches that unite groups.  Equal
integers that follow each other are one occurrence with a length: two such runs vote for each offset at which they
overlap, as often as their integers meet there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import components, shared

RATE, FRAME, HOP, WIDTH = 8000, 256, 64, 16
#: Frequency of the lowest pitch (Hz), and the weights of the five frames that are smoothed.
LOWEST, SMOOTH = 440.0, (1, 3, 4, 3, 1)
#: A frame's pitch classes add up to about this.
SCALE = 12_000
VOTES, ERRORS = 4, 5
#: Samples of VOTES integers.
LEAST = FRAME + HOP * (len(SMOOTH) - 1 + WIDTH - 1 + VOTES - 1)
#: Occurrences of a value in a block.
BLOCK = 1000
#: Occurrences of a value whose pairs are rows; recordings with one of more in a block, and integers that are compared at once.
FEW, TILE, CELLS = 32, 250, 1 << 18
#: Frames that are in memory as numbers at once.
CHUNK = 8192
#: Filters (kind, first pitch class, pitch classes, frames), and the thresholds of (1 + A) / (1 + B).
FILTERS = [
    (0, 4, 3, 15), (4, 4, 6, 15), (1, 0, 4, 16), (3, 8, 2, 12), (3, 4, 4, 8), (4, 0, 3, 5), (1, 2, 2, 9), (2, 7, 3, 4),
    (2, 6, 2, 16), (2, 1, 3, 2), (5, 10, 1, 15), (3, 6, 2, 10), (2, 1, 1, 14), (3, 5, 6, 4), (1, 9, 2, 12), (3, 4, 2, 14),
]
THRESHOLDS = [
    (41200.0, 44600.0, 48130.0), (0.4291, 0.4861, 0.5488), (0.9075, 1.051, 1.205), (0.839, 1.0, 1.194),
    (0.8669, 1.0, 1.151), (0.3822, 0.4875, 0.6212), (0.786, 0.9935, 1.238), (0.8875, 1.0, 1.132),
    (0.8535, 1.0, 1.17), (0.9291, 1.0, 1.077), (0.3956, 0.4943, 0.6148), (0.8376, 1.0, 1.194),
    (0.787, 1.0, 1.275), (0.91, 1.0, 1.1), (0.875, 1.062, 1.32), (0.8471, 1.0, 1.171),
]
GRAY = (0, 1, 3, 2)


def tables() -> np.ndarray:
    """Cosines and sines of the pitches under a Hann window, as whole numbers: FRAME rows of 36 + 36."""
    t = np.arange(FRAME)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * t / FRAME)
    turns = 2 * np.pi * t[:, None] * (LOWEST * 2.0 ** (np.arange(36) / 12))[None, :] / RATE
    return np.rint(np.hstack([np.cos(turns), np.sin(turns)]) * hann[:, None] * 32767)


TABLES = tables()


def pitches(samples: np.ndarray) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame of one recording; sums of products stay below 2 ** 53."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = []
    for at in range(0, len(frames), CHUNK):
        found = (frames[at : at + CHUNK].astype(np.float64) - 128.0) @ TABLES
        energy = found[:, :36] * found[:, :36] + found[:, 36:] * found[:, 36:]
        out.append(energy[:, :12] + energy[:, 12:24] + energy[:, 24:])
    return np.concatenate(out)


def chroma(energy: np.ndarray) -> np.ndarray:
    """Smoothed pitch classes in whole numbers; four frames fewer."""
    n = len(energy) - len(SMOOTH) + 1
    if n <= 0:
        return np.zeros((0, 12), np.int64)
    smooth = np.zeros((n, 12))
    for k, weight in enumerate(SMOOTH):
        smooth = smooth + energy[k : k + n] * weight
    total = np.zeros(n)
    for c in range(12):
        total = total + smooth[:, c]
    return np.rint(smooth / np.where(total > 0, total, 1.0)[:, None] * SCALE).astype(np.int64)


def parts(kind: int, height: int, width: int) -> list[tuple[int, int, int, int, bool]]:
    """Rectangles (pitch class, frame, pitch classes, frames) of a filter, and whether they count in A or in B."""
    h, w = height // 2, width // 2
    if kind == 0:
        return [(0, 0, height, width, True)]
    if kind == 1:
        return [(h, 0, height - h, width, True), (0, 0, h, width, False)]
    if kind == 2:
        return [(0, w, height, width - w, True), (0, 0, height, w, False)]
    if kind == 3:
        return [(0, w, h, width - w, True), (h, 0, height - h, w, True), (0, 0, h, w, False), (h, w, height - h, width - w, False)]
    if kind == 4:
        h = height // 3
        return [(h, 0, h, width, True), (0, 0, h, width, False), (2 * h, 0, height - 2 * h, width, False)]
    w = width // 3
    return [(0, w, height, w, True), (0, 0, height, w, False), (0, 2 * w, height, width - 2 * w, False)]


def ratios(image: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """1 + A and 1 + B of each filter at each place."""
    n = len(image) - WIDTH + 1
    sums = np.zeros((len(image) + 1, 13), np.int64)
    sums[1:, 1:] = image.cumsum(0).cumsum(1)
    for kind, low, height, width in FILTERS:
        sides = {True: np.ones(n, np.int64), False: np.ones(n, np.int64)}
        for c, t, h, w, side in parts(kind, height, width):
            c += low
            sides[side] = sides[side] + (sums[t + w : t + w + n, c + h] - sums[t : t + n, c + h] - sums[t + w : t + w + n, c] + sums[t : t + n, c])
        yield sides[True], sides[False]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """The packed integers of one recording; a short one is repeated."""
    if 0 < len(samples) < LEAST:
        samples = np.resize(samples, LEAST)
    image = chroma(pitches(samples))
    if len(image) < WIDTH:
        return np.zeros(0, np.int32)
    out = np.zeros(len(image) - WIDTH + 1, np.uint32)
    gray = np.array(GRAY, np.uint32)
    for (a, b), levels in zip(ratios(image), THRESHOLDS):
        level = np.zeros(len(out), np.int64)
        for limit in levels:
            level += a > b * limit
        out = (out << np.uint32(2)) | gray[level]
    return out.view(np.int32)


def prints(recordings: DataFrame) -> DataFrame:
    """Rows (doc_id, items) of recordings (doc_id, samples binary)."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(np.frombuffer(s.as_buffer() if s.is_valid else b"", np.uint8)) for s in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), items], ["doc_id", "items"])

    return recordings.select(F.col("doc_id").cast("long"), "samples").mapInArrow(run, "doc_id long, items array<int>")


def errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Overlap and differing bits, with place p of *a* over place p + offset of *b*."""
    low, high = max(0, -offset), min(len(a), len(b) - offset)
    return high - low, int(np.bitwise_count(a[low:high].view(np.uint32) ^ b[low + offset : high + offset].view(np.uint32)).sum())


def voted(a: np.ndarray, b: np.ndarray) -> list[int]:
    """All offsets with votes enough."""
    order = np.argsort(b, kind="stable")
    first, last = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    votes = np.zeros(len(a) + len(b), np.int64)
    ends = np.concatenate([[0], np.cumsum(last - first)])
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CELLS, "right")) - 1)
        n = (last - first)[at:to]
        p = np.repeat(np.arange(at, to), n)
        q = order[np.repeat(first[at:to] - ends[at:to], n) + np.arange(ends[at], ends[to])]
        votes += np.bincount(q - p + len(a), minlength=len(votes))
        at = to
    return (np.flatnonzero(votes >= VOTES) - len(a)).tolist()


def best(a: np.ndarray, b: np.ndarray, offsets: list[int]) -> tuple[int, int, int] | None:
    """If one of the offsets has few enough bit errors: of all with votes enough the one with the fewest for its overlap, with overlap and bit errors."""

    def fit(offsets):
        for x in offsets:
            overlap, bits = errors(a, b, x)
            if 2 * overlap >= min(len(a), len(b)) and bits <= ERRORS * overlap:
                yield x, overlap, bits

    if next(fit(offsets), None) is None:
        return None
    return min(fit(voted(a, b)), key=lambda f: (f[2] / f[1], -f[1], abs(f[0]), f[0]), default=None)


def confirmed(votes: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (a, b, shift, overlap, bits) of the votes (a, b, shift) with a match, at its best offset; integers are joined once for each pair."""

    def run(batches):
        for batch in batches:
            ours, theirs = batch.column(3), batch.column(4)
            found = [best(ours[i].values.to_numpy(), theirs[i].values.to_numpy(), offsets) for i, offsets in enumerate(batch.column(2).to_pylist())]
            keep = pa.array([f is not None for f in found], pa.bool_())
            told = list(zip(*(f for f in found if f is not None))) or [[]] * 3
            columns = [batch.column(0).filter(keep), batch.column(1).filter(keep), *(pa.array(x, pa.int32()) for x in told)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "shift", "overlap", "bits"])

    side = lambda n, items: known.select(F.col("print").alias(n), F.col("items").alias(items))
    rows = votes.groupBy("a", "b").agg(F.collect_list("shift").alias("shifts")).join(side("a", "_a"), "a").join(side("b", "_b"), "b")
    return rows.select("a", "b", "shifts", "_a", "_b").mapInArrow(run, "a long, b long, shift int, overlap int, bits int")


def aligned(links: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (print, best_with, best_shift, best_overlap, best_bits): each print's best link; place p lies over place p + shift of the other."""
    ends = F.array(F.struct(F.col("a").alias("print"), F.col("b").alias("other"), F.col("shift").alias("at")), F.struct(F.col("b").alias("print"), F.col("a").alias("other"), (-F.col("shift")).alias("at")))
    rows = links.select(F.explode(ends).alias("e"), "overlap", "bits").select("e.print", F.struct((F.col("bits") / F.col("overlap")).alias("rate"), (-F.col("overlap")).alias("short"), "e.other", "e.at", "overlap", "bits").alias("x"))
    one = rows.groupBy("print").agg(F.min("x").alias("x"))
    other = known.select(F.col("print").alias("other"), F.col("least").alias("best_with"))
    return one.select("print", "x.other", F.col("x.at").alias("best_shift"), F.col("x.overlap").alias("best_overlap"), F.col("x.bits").alias("best_bits")).join(other, "other").drop("other")


def runs(known: DataFrame) -> DataFrame:
    """Rows (print, pos, value, length) of the runs of equal integers, of recordings that can have votes enough."""

    def run(batches):
        for batch in batches:
            names, items = batch.column(0).to_numpy(), batch.column(1)
            ends = items.offsets.to_numpy() - items.offsets[0].as_py()
            values = items.flatten().to_numpy()
            owner = np.repeat(np.arange(len(names)), np.diff(ends))
            new = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])[: len(values)])
            length = np.diff(np.append(new, len(values)))
            columns = [pa.array(names[owner[new]], pa.int64()), pa.array(new - ends[owner[new]], pa.int32()), pa.array(values[new], pa.int32()), pa.array(length, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["print", "pos", "value", "length"])

    return known.filter(F.size("items") >= VOTES).select("print", "items").mapInArrow(run, "print long, pos int, value int, length int")


def counted(pairs: DataFrame) -> DataFrame:
    """Offset histograms of (a, b, shift, votes), with partial sums; what has votes enough."""
    return pairs.groupBy("a", "b", "shift").agg(F.sum("votes").alias("n")).filter(F.col("n") >= VOTES).drop("n")


def stars(posts: DataFrame) -> DataFrame:
    """Votes of each value's occurrences with its smallest and its largest recording, these two with each other once; of a run only its first integer's."""
    one = F.struct("print", "pos")
    ends = posts.groupBy("value").agg(F.min(one).alias("low"), F.max(one).alias("high")).filter("low.print <> high.print")
    rows = posts.join(ends, "value").filter(one != F.col("low")).select("print", "pos", F.explode(F.array("low", "high")).alias("e")).filter("print <> e.print")
    ours = F.col("print") < F.col("e.print")
    return counted(rows.select(F.least("print", "e.print").alias("a"), F.greatest("print", "e.print").alias("b"), F.when(ours, F.col("e.pos") - F.col("pos")).otherwise(F.col("pos") - F.col("e.pos")).alias("shift"), F.lit(1).alias("votes")))


def crossing(posts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Votes of all pairs of occurrences of a value in different groups; posts are (value, print, pos, length, root)."""
    several = posts.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    rows = posts.join(several.select("value", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "value")
    own, all_ = F.pmod(F.xxhash64("print", "pos"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ours = rows.select("value", F.col("print").alias("a"), F.col("pos").alias("p"), F.col("length").alias("m"), F.col("root").alias("ra"), own.alias("i"), all_.alias("j"))
    theirs = rows.select("value", F.col("print").alias("b"), F.col("pos").alias("q"), F.col("length").alias("n"), F.col("root").alias("rb"), all_.alias("i"), own.alias("j"))
    pairs = ours.join(theirs, ["value", "i", "j"]).filter("a < b and ra <> rb").select("a", "b", "p", "q", "m", "n", F.explode(F.expr("sequence(1 - m, n - 1)")).alias("d"))
    return counted(pairs.selectExpr("a", "b", "q - p + d as shift", "least(m, n - d) - greatest(0, -d) as votes"))


def common(posts: DataFrame) -> DataFrame:
    """The runs of values that several recordings have, with the number of their runs (n); dealt out once by value."""
    posts = posts.repartition(shared.partitions(posts.sparkSession), "value")
    several = posts.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("low"), F.max("print").alias("high")).filter("low <> high")
    return posts.join(several.select("value", "n"), "value")


class Tile:
    """Recordings of one or two blocks that have a value: their integers one after another with room around them, and the value's runs; shorter recordings first."""

    def __init__(self, table: pa.Table):
        names, roots, own = (table[c].to_numpy() for c in ("print", "root", "own"))
        items, at, length = (table[c].to_pylist() if c != "items" else [x.values.to_numpy().view(np.uint32) for x in table[c]] for c in ("items", "at", "length"))
        sizes = np.array([len(x) for x in items])
        order = np.lexsort((names, sizes))
        self.names, self.own, self.sizes, self.root = names[order], own[order], sizes[order], roots[order].copy()
        self.items = [items[k] for k in order]
        self.room = int(self.sizes[-1])
        self.flat = np.concatenate([np.zeros(self.room, np.uint32), *self.items, np.zeros(self.room, np.uint32)])
        self.base = self.room + np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(order)), [len(at[k]) for k in order])
        self.at = np.array([x for k in order for x in at[k]], np.int64)
        self.length = np.array([x for k in order for x in length[k]], np.int64)
        self.runs = np.searchsorted(self.row, np.arange(len(order) + 1))

    def offsets(self, a: int, cross: bool) -> tuple[np.ndarray, np.ndarray]:
        """Later recordings of other groups, and offsets at which the value meets that of *a* and the overlap is long enough."""
        fit = self.root != self.root[a]
        if cross:
            fit &= self.own != self.own[a]
        fit[: a + 1] = False
        rows = np.flatnonzero(fit)
        mine = np.flatnonzero(fit[self.row])
        size, width = int(self.sizes[a]), int(self.sizes[a]) + self.room
        place = np.cumsum(fit) - 1
        met = np.zeros(len(rows) * width, bool)
        for run in range(self.runs[a], self.runs[a + 1]):
            m = self.length[run]
            each = m + self.length[mine] - 1
            low = place[self.row[mine]] * width + self.at[mine] - self.at[run] + 1 - m + size
            met[np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum())] = True
        found = np.flatnonzero(met)
        b, offset = rows[found // width], found % width - size
        overlap = np.minimum(size, self.sizes[b] - offset) - np.maximum(0, -offset)
        keep = (2 * overlap >= size) & (overlap >= VOTES)
        return b[keep], offset[keep]

    def fitting(self, a: int, b: np.ndarray, offset: np.ndarray) -> Iterator[tuple[int, int]]:
        """Recordings and offsets that match *a*.  Every other place is compared first: its bit errors alone exceed the limit mostly."""
        ours, size = self.items[a], int(self.sizes[a])
        windows = np.lib.stride_tricks.sliding_window_view(self.flat, size)
        low, high = np.maximum(0, -offset).astype(np.int32), np.minimum(size, self.sizes[b] - offset).astype(np.int32)
        start, limit, columns = self.base[b] + offset, ERRORS * (high - low), np.arange(size, dtype=np.int32)
        step = max(1, CELLS // size)
        for at in range(0, len(b), step):
            left = np.arange(at, min(at + step, len(b)))
            for every in (2, 1):
                place = columns[::every]
                inside = (place >= low[left, None]) & (place < high[left, None])
                differ = windows[:, ::every][start[left]] ^ ours[::every]
                keep = (np.bitwise_count(differ) * inside).sum(axis=1, dtype=np.int64) <= limit[left]
                if every == 1:
                    keep &= ((differ == 0) & inside).sum(axis=1) >= VOTES
                left = left[keep]
                if not len(left):
                    break
            yield from zip(b[left].tolist(), offset[left].tolist())

    def links(self, cross: bool) -> Iterator[tuple[int, int, int, int, int]]:
        """Matches (a, b, shift, overlap, bits) that unite groups."""
        for a in range(len(self.names)):
            for b, offset in self.fitting(a, *self.offsets(a, cross)):
                if self.root[a] != self.root[b]:
                    self.root[self.root == self.root[b]] = self.root[a]
                    shift, overlap, bits = best(self.items[a].view(np.int32), self.items[b].view(np.int32), [offset])
                    one, two = int(self.names[a]), int(self.names[b])
                    yield (one, two, shift, overlap, bits) if one < two else (two, one, -shift, overlap, bits)


def frequent(posts: DataFrame, known: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows (a, b, shift, overlap, bits): matches of recordings of different groups at offsets where values of the posts (value, print, pos, length, root) meet.

    A value's recordings are dealt into blocks; each pair of blocks is checked by one task, and told by matches that unite their groups.
    """

    def run(table: pa.Table) -> pa.Table:
        found = list(zip(*Tile(table).links(table["i"][0].as_py() != table["j"][0].as_py()))) or [[]] * 5
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(found, [pa.int64()] * 2 + [pa.int32()] * 3)], ["a", "b", "shift", "overlap", "bits"])

    values = posts.groupBy("value").agg(F.countDistinct("print").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    blocks = values.select("value", F.ceil(F.col("n") / tile).cast("int").alias("blocks"))
    rows = posts.groupBy("value", "print", "root").agg(F.collect_list("pos").alias("at"), F.collect_list("length").alias("length")).join(blocks, "value")
    rows = rows.groupBy("print", "root").agg(F.collect_list(F.struct("value", "blocks", "at", "length")).alias("values")).join(known.select("print", "items"), "print")
    rows = rows.select("print", "root", "items", F.explode("values").alias("v")).select("print", "root", "items", "v.*").withColumn("own", F.pmod(F.xxhash64("print"), "blocks").cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = rows.select("value", "i", "j", "own", "print", "root", "at", "length", "items").repartition(shared.partitions(posts.sparkSession), "value", "i", "j")
    return rows.groupBy("value", "i", "j").applyInArrow(run, "a long, b long, shift int, overlap int, bits int")


def groups(recordings: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each recording: its number of integers, the group's smallest doc_id, the recordings in the group, and its alignment.

    The alignment is the doc_id of another recording of the group (aligned_with), and the shift in places, the overlap and the bit errors
    with it; null for a recording without others.  Copies with equal integers are aligned with the smallest doc_id of them, and that one, if nothing else matches, with the largest.
    """
    spark = recordings.sparkSession
    shared.tune(spark)
    rows = shared.written(prints(recordings).select("doc_id", F.size("items").alias("n_items"), F.when(F.size("items") > 0, F.xxhash64("items")).alias("print"), "items"), "prints")
    known = rows.filter("n_items > 0").groupBy("print").agg(F.first("items").alias("items"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("copies"))
    known = shared.written(known, "distinct-prints")
    posts = shared.written(common(runs(known)), "posts")
    shared.release(spark)
    links = shared.written(confirmed(stars(posts), known), "links")
    roots = components.connected(links)
    shared.release(spark)
    rooted = posts.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    few = min(block, FEW)
    links = links.unionByName(shared.written(confirmed(crossing(rooted.filter(F.col("n") <= few), block), known), "links"))
    shared.release(spark)
    links = links.unionByName(shared.written(frequent(rooted.filter(F.col("n") > few), known, min(block, TILE)), "links"))
    shared.release(spark)
    roots = components.connected(links)
    of = known.drop("items").join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    whole = of.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("copies").alias("recordings"))
    of = of.join(whole, "root").select("print", "least", "most", "copies", "group_id", "recordings").join(aligned(links, known), "print", "left")
    of = shared.written(of, "print-groups")
    first = F.col("doc_id").eqNullSafe(F.col("least"))
    copy = ~first | (F.col("copies") > 1) & F.col("best_shift").isNull()
    told = {"aligned_with": ("best_with", F.when(first, F.col("most")).otherwise(F.col("least"))), "shift": ("best_shift", F.lit(0)), "overlap": ("best_overlap", F.col("n_items")), "bit_errors": ("best_bits", F.lit(0))}
    told = [F.when(copy, same).otherwise(F.col(match)).alias(name) for name, (match, same) in told.items()]
    out = rows.filter("n_items > 0").join(of, "print").select("doc_id", "n_items", "group_id", "recordings", *told)
    alone = rows.filter("n_items = 0").select("doc_id", "n_items", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("recordings"))
    return out.unionByName(alone, allowMissingColumns=True)
