"""Operator 10: exact substring de-duplication over a collection's suffix order.

A byte goes if it is covered by a string of SPAN bytes that also starts in a document with a smaller
id; strings are judged on the input, and matches don't cross documents.

1. Anchors.  Of the GRAM-byte strings inside every SPAN-byte window, the one with the smallest hash
   (the first of equals) is the window's anchor.  Equal windows have the same anchor at the same
   place.  Anchors are exchanged as packed numbers in blobs by bucket; those that occur in one
   document only can't lie in a repeated window and fall away, as does the text around them.
2. Segments.  Documents meet their surviving anchors in one shuffle by a hash of the id.  Adjacent
   windows with one anchor make a segment of at most 2 * SPAN - GRAM bytes.  Segments are dealt by
   anchor, so all equal windows meet.
3. Suffix order.  A task takes COLLECTION bytes of different segments at a time, never cutting an
   anchor's segments apart, and builds their Burrows-Wheeler transform and common prefixes column
   by column (see ``bwt``).  Rows whose common prefix has SPAN bytes or more form a group; where its
   smallest document is smaller than a segment's, the segment's window is covered.
4. Covered ranges return to the documents in a last shuffle, which unites and cuts them out.

An anchor in more than HOT documents is dealt by window instead: its windows' smallest documents are
found by an aggregation with partial sums and joined back, which adaptive execution can split.
Documents with equal texts are told apart beforehand: only the smallest goes through the above, and
the others go whole if they have SPAN bytes (all their windows start in the smaller one).

Null text is empty.  A null id counts as larger than all others, and null ids don't remove from each
other.  Rows that share an id don't remove from each other; each has its own result.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bwt, shared, words

SPAN, GRAM = 50, 26
#: Bytes of different segments in one collection.
COLLECTION = 1 << 20
#: Documents of an anchor that is dealt by window.
HOT = 5_000
#: Text of a map batch, and of a slice of the anchor kernel.
TEXT, SLICE = 16 << 20, 1 << 17

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LAST = np.iinfo(np.int64).max


def _grams(part: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings, by doubling."""
    out, have = None, 0
    block, size = _BYTE[part], 1
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if out is None:
                    out = block
                else:
                    power = np.uint64(pow(_BASE, size, 1 << 64))
                    n = min(len(out), len(block) - have)
                    out = out[:n] * power + block[have : have + n]
                have += size
            if 2 * size > k:
                return words.mix(out[: len(part) - k + 1])
            block = block[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + block[size:]
            size *= 2


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """Runs of adjacent windows with one anchor: document, first and last window start, anchor's place and hash."""
    width = span - gram + 1
    docs, firsts, lasts, places, hashes = [], [], [], [], []
    n, at = len(offsets) - 1, 0
    doc = 0
    end = int(offsets[-1])
    bits = np.uint64(SLICE.bit_length() + 1)
    low = np.uint64((1 << int(bits)) - 1)
    while at < end:
        # window starts at .. to; their bytes reach span - 1 further, inside the last document
        to = min(at + SLICE, end)
        while doc + 1 < n and offsets[doc + 1] <= at:
            doc += 1
        last = int(np.searchsorted(offsets, to, side="left"))
        stop = min(to + span - 1, int(offsets[last]))
        part = data[at:stop]
        count = len(part) - span + 1
        if count > 0:
            gh = _grams(part, gram)
            value = (gh & ~low) | np.arange(len(gh), dtype=np.uint64)
            step, low_at = value, 1
            while 2 * low_at <= width:
                step = np.minimum(step[:-low_at], step[low_at:])
                low_at *= 2
            best = np.minimum(step[: len(step) - (width - low_at)], step[width - low_at :]) if width > low_at else step
            place = (best[:count] & low).astype(np.int64)
            ends = offsets[doc + 1 : last + 1] - at
            begins = np.concatenate([[0], ends[:-1]])
            valid = np.zeros(count + 1, np.int64)  # +1 and -1 where a document's windows begin and end
            good = ends - begins >= span
            np.add.at(valid, begins[good], 1)
            np.add.at(valid, np.minimum(ends[good] - span + 1, count), -1)
            start = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
            if len(start):
                mine = place[start]
                fresh = np.ones(len(start), bool)
                owner = np.searchsorted(ends, start, side="right")
                fresh[1:] = (mine[1:] != mine[:-1]) | (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1])
                head = np.flatnonzero(fresh)
                tail = np.append(head[1:], len(start)) - 1
                docs.append(owner[head] + doc)
                firsts.append(start[head] + at)
                lasts.append(start[tail] + at)
                places.append(mine[head] + at)
                hashes.append(gh[mine[head]])
        at = to
    if not docs:
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in (docs, firsts, lasts, places, hashes))


def _requests(docs: DataFrame, buckets: int, span: int, gram: int) -> DataFrame:
    """Rows (bucket, docs, counts, prints): each document's distinct anchors, by bucket, packed."""

    def run(batches):
        for table in words.regroup(batches, "text", TEXT):
            ids = table["doc_id"].to_numpy()
            doc, _, _, _, fp = anchors(*words.column_bytes(table["text"]), span, gram)
            bucket = (fp >> np.uint64(40)) % np.uint64(buckets)
            order = np.lexsort((fp & np.uint64(0xFFFFFFFF), doc, bucket))
            b, d, f = bucket[order], doc[order], fp[order] & np.uint64(0xFFFFFFFF)
            new = np.ones(len(b), bool)
            new[1:] = (b[1:] != b[:-1]) | (d[1:] != d[:-1]) | (f[1:] != f[:-1])
            b, d, f = b[new], d[new], f[new]
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
            rows = []
            for lo, hi in zip(cut, [*cut[1:], len(b)]):
                heads = np.flatnonzero(np.concatenate([[True], d[lo + 1 : hi] != d[lo : hi - 1]]))
                counts = np.diff(np.append(heads, hi - lo))
                rows.append((int(b[lo]), ids[d[lo:hi][heads]].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), f[lo:hi].astype("<u4").tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "docs", "counts", "prints"])

    return docs.mapInArrow(run, "bucket int, docs binary, counts binary, prints binary")


def _replies(requests: DataFrame, blocks: int, hot: int) -> DataFrame:
    """Rows (block, docs, keys): anchors that occur in two documents or more, by block of the document; the keys' lowest bit says hot."""

    def run(batches):
        docs, keys = [], []
        for batch in batches:
            for bucket, ids, counts, prints in zip(*(c.to_pylist() for c in batch.columns)):
                f = np.frombuffer(prints, "<u4").astype(np.uint64)
                docs.append(np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<u4")))
                keys.append((np.uint64(bucket) << np.uint64(33)) | (f << np.uint64(1)))
        if not docs:
            return
        doc, key = np.concatenate(docs), np.concatenate(keys)
        del docs, keys
        order = np.argsort(key, kind="stable")
        doc, key = doc[order], key[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.repeat(np.diff(np.append(head, len(key))), np.diff(np.append(head, len(key))))
        keep = times > 1
        doc, key = doc[keep], key[keep] | (times[keep] > hot).astype(np.uint64)
        block = _block(doc, blocks)
        order = np.argsort(block, kind="stable")
        doc, key, block = doc[order], key[order], block[order]
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
        rows = [(int(block[lo]), doc[lo:hi].tobytes(), key[lo:hi].tobytes()) for lo, hi in zip(cut, [*cut[1:], len(block)])]
        columns = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.binary(), pa.binary()])], ["block", "docs", "keys"])

    return requests.mapInArrow(run, "block int, docs binary, keys binary")


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (words.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x1234567)) % np.uint64(blocks)).astype(np.int32)


def _with_block(docs: DataFrame, by: str, blocks: int) -> DataFrame:
    at = docs.columns.index(by)

    def run(batches):
        for batch in batches:
            ids = batch.column(at).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_block(ids, blocks), pa.int32()), *batch.columns], ["block", *batch.schema.names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, "block int, " + fields)


SEGMENTS = "kind int, key long, segment binary, doc_id long, row long, start long"


def _segments(docs: DataFrame, replies: DataFrame, copies: DataFrame, buckets: int, parts: int, span: int, gram: int) -> DataFrame:
    """Segments of surviving anchors (kind 0: key is the anchor), and windows of hot ones (kind 1: key is the window's hash)."""
    none = F.lit(None)
    ours = docs.select("block", F.lit(1).alias("kind"), "doc_id", "row", "text", none.cast("binary").alias("docs"), none.cast("binary").alias("keys"))
    theirs = replies.select("block", F.lit(0).alias("kind"), none.cast("long").alias("doc_id"), none.cast("long").alias("row"), none.cast("string").alias("text"), "docs", "keys")
    known = copies.select("block", F.lit(0).alias("kind"), "doc_id", "row", none.cast("string").alias("text"), none.cast("binary").alias("docs"), none.cast("binary").alias("keys"))
    rows = ours.unionByName(theirs).unionByName(known).repartition(parts, "block").sortWithinPartitions("kind").select("kind", "doc_id", "row", "text", "docs", "keys")

    def run(batches):
        heard_docs, heard_keys, copied = [], [], []
        known: dict[int, tuple[int, int]] | None = None
        keys = None
        for table in words.regroup(batches, "text", 4 << 20):
            kind = table["kind"].to_numpy()
            told = int((kind == 0).sum())
            for d, k, r in zip(table["docs"].to_pylist()[:told], table["keys"].to_pylist(), table["row"].to_pylist()):
                if d is None:
                    copied.append(r)
                    continue
                heard_docs.append(np.frombuffer(d, np.int64))
                heard_keys.append(np.frombuffer(k, np.uint64))
            table = table.filter(pa.array(kind == 1))
            if not table.num_rows:
                continue
            if known is None:
                doc, keys = (np.concatenate(heard_docs), np.concatenate(heard_keys)) if heard_docs else (np.empty(0, np.int64), np.empty(0, np.uint64))
                heard_docs = heard_keys = None
                order = np.lexsort((keys, doc))
                doc, keys = doc[order], keys[order]
                head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
                known = dict(zip(doc[head].tolist(), zip(head.tolist(), np.append(head[1:], len(doc)).tolist())))
            ids = table["doc_id"].to_numpy()
            told = np.array([int(i) in known for i in ids], bool) & ~np.isin(table["row"].to_numpy(), np.array(copied, np.int64))
            table, ids = table.filter(pa.array(told)), ids[told]
            if not table.num_rows:
                continue
            data, offsets = words.column_bytes(table["text"])
            of, first, last, _, fp = anchors(data, offsets, span, gram)
            key = (((fp >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(33)) | ((fp & np.uint64(0xFFFFFFFF)) << np.uint64(1))
            cold, warm = np.zeros(len(key), bool), np.zeros(len(key), bool)
            cut = np.searchsorted(of, np.arange(len(ids) + 1))
            for i, d in enumerate(ids.tolist()):
                lo, hi = known[d]
                mine = slice(cut[i], cut[i + 1])
                have = keys[lo:hi]
                at = np.minimum(np.searchsorted(have, key[mine]), hi - lo - 1)
                cold[mine] = have[at] == key[mine]
                warm[mine] = have[at] == (key[mine] | np.uint64(1))
            starts = np.concatenate([first[cold], words.ragged(first[warm], last[warm] - first[warm] + 1)])
            sizes = np.concatenate([last[cold] - first[cold] + span, np.full(len(starts) - int(cold.sum()), span)])
            owner = np.concatenate([of[cold], np.repeat(of[warm], last[warm] - first[warm] + 1)])
            raw = data[words.ragged(starts, sizes)].tobytes()
            places = np.concatenate([[0], np.cumsum(sizes)])
            segment = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(raw)])
            n_cold = int(cold.sum())
            kinds = np.concatenate([np.zeros(n_cold, np.int32), np.ones(len(starts) - n_cold, np.int32)])
            names = np.concatenate([fp[cold], np.repeat(fp[warm], last[warm] - first[warm] + 1)])
            out = pa.RecordBatch.from_pydict({
                "kind": pa.array(kinds), "key": pa.array(names.view(np.int64)), "segment": segment,
                "doc_id": pa.array(ids[owner]), "row": pa.array(table["row"].to_numpy()[owner]), "start": pa.array(starts - offsets[owner]),
            })
            for at in range(0, out.num_rows, 20_000):
                yield out.slice(at, 20_000)

    return rows.mapInArrow(run, SEGMENTS)


def _covered(segment_bytes: pa.Array, ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered ranges (row, begin, end) of one collection's segment instances."""
    coded = segment_bytes.dictionary_encode()
    code = coded.indices.to_numpy()
    data, offsets = words.column_bytes(coded.dictionary)
    n = len(offsets) - 1
    least = np.full(n, _LAST, np.int64)
    np.minimum.at(least, code, ids)
    _, lcp, string, length = bwt.build(data, offsets, most=span)
    group = np.cumsum(lcp < span) - 1
    low = np.full(int(group[-1]) + 1, _LAST, np.int64)
    np.minimum.at(low, group, least[string])
    # of every string: the smallest document of each of its windows, by offset
    size = np.diff(offsets)
    row = length >= span
    slots = np.concatenate([[0], np.cumsum(np.maximum(size - span + 1, 0))])
    window = np.empty(int(slots[-1]), np.int64)
    window[slots[string[row]] + size[string[row]] - length[row]] = low[group[row]]
    # instances
    count = (slots[1:] - slots[:-1])[code]
    at = words.ragged(slots[code], count)
    who = np.repeat(np.arange(len(code)), count)
    hit = window[at] < ids[who]
    offset = at - slots[code][who]
    who, offset = who[hit], offset[hit]
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (offset[1:] != offset[:-1] + 1)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(who)) - 1 if len(who) else head
    return rows[who[head]], starts[who[head]] + offset[head], starts[who[head]] + offset[tail] + span


def _ranges(segments: DataFrame, parts: int, span: int, collection: int) -> DataFrame:
    """Rows (row, begin, end) of covered ranges."""
    cold = segments.filter("kind = 0").select("key", "segment", "doc_id", "row", "start").repartition(parts, "key").sortWithinPartitions("key")

    def run(batches):
        held: list[pa.RecordBatch] = []
        have, last = 0, None

        def flush(batches: list[pa.RecordBatch]):
            table = pa.Table.from_batches(batches)
            row, begin, end = _covered(table["segment"].combine_chunks(), table["doc_id"].to_numpy(), table["row"].to_numpy(), table["start"].to_numpy(), span)
            return pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int64()), "begin": pa.array(begin, pa.int64()), "end": pa.array(end, pa.int64())})

        for batch in batches:
            key = batch.column(0).to_numpy()
            _, offsets = words.column_offsets(batch.column(1))
            offsets = offsets - offsets[0]
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            at = 0
            for c in cut:  # where an anchor begins
                if c == 0 and key[0] == last:
                    continue
                if have + int(offsets[c] - offsets[at]) >= collection:
                    if c > at:
                        held.append(batch.slice(at, c - at))
                    if held:
                        yield flush(held)
                    held, have, at = [], 0, c
            if batch.num_rows > at:
                held.append(batch.slice(at))
                have += int(offsets[-1] - offsets[at])
            last = key[-1]
        if held:
            yield flush(held)

    found = cold.mapInArrow(run, "row long, begin long, end long")
    warm = segments.filter("kind = 1").select("segment", "doc_id", "row", "start")
    # stored, so that the join's sides are shuffles of their own and adaptive execution can split a common window's rows
    least = shared.written(warm.groupBy("segment").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"), "repeats-least")
    warm = warm.join(least, "segment").filter("least < doc_id").select("row", F.col("start").alias("begin"), (F.col("start") + span).alias("end"))
    return found.unionByName(warm)


def dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, hot: int = HOT, collection: int = COLLECTION) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if *keep_text*."""
    if not 0 < gram <= span:
        raise ValueError("gram must lie in 1..span")
    spark = docs.sparkSession
    shared.tune(spark)
    parts = shared.partitions(spark)
    buckets = blocks = 2 * parts
    last = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))
    plain = docs.select(last.alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    plain = plain.withColumn("row", F.xxhash64("doc_id", "text"))  # rows that are equal have equal results

    # equal texts: the smallest id stands for them; only names of texts are shuffled
    names = plain.filter(F.octet_length("text") >= span).select("doc_id", "row", F.unhex(F.sha2("text", 256)).alias("sha"))
    names = shared.written(names, "repeats-names")
    least = names.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    copies = shared.written(names.join(least, "sha").filter("doc_id > least").select("doc_id", "row").distinct(), "repeats-copies")
    shared.dropped(names)

    # without the copies, so that a text is not taken for repeated because of them alone
    requests = _requests(plain.join(copies.select("row"), "row", "left_anti").select("doc_id", "text"), buckets, span, gram).repartition(parts, "bucket")
    replies = shared.written(_replies(requests, blocks, hot), "repeats-anchors")
    del names, least, requests
    shared.release(spark)
    segments = shared.written(_segments(_with_block(plain, "doc_id", blocks), replies, _with_block(copies, "doc_id", blocks), buckets, parts, span, gram), "repeats-segments")
    shared.dropped(replies)
    shared.release(spark)
    ranges = shared.written(_ranges(segments, parts, span, collection), "repeats-ranges")
    shared.dropped(segments)
    shared.release(spark)
    return _cut(plain, ranges, copies, blocks, parts, keep_text).withColumn("doc_id", F.when(F.col("doc_id") != _LAST, F.col("doc_id")))


def _cut(docs: DataFrame, ranges: DataFrame, copies: DataFrame, blocks: int, parts: int, keep_text: bool) -> DataFrame:
    ours = _with_block(docs, "row", blocks).select("block", F.lit(1).alias("kind"), "row", "doc_id", "text", F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"))
    theirs = _with_block(ranges, "row", blocks).select("block", F.lit(0).alias("kind"), "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "begin", "end")
    whole = copies.withColumns({"begin": F.lit(0).cast("long"), "end": F.lit(_LAST)}).select("row", "begin", "end")
    theirs = theirs.unionByName(_with_block(whole, "row", blocks).select("block", F.lit(0).alias("kind"), "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "begin", "end"))
    rows = ours.unionByName(theirs).repartition(parts, "block").sortWithinPartitions("kind").select("kind", "row", "doc_id", "text", "begin", "end")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def run(batches):
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        known: dict[int, tuple[int, int]] | None = None
        for batch in batches:
            kind = batch.column(0).to_numpy()
            n = int((kind == 0).sum())
            if n:
                found.append(tuple(batch.column(c).slice(0, n).to_numpy() for c in (1, 4, 5)))
            if n == batch.num_rows:
                continue
            if known is None:
                doc, begin, end = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
                order = np.lexsort((begin, doc))
                doc, begin, end = doc[order], begin[order], end[order]
                head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
                known = dict(zip(doc[head].tolist(), zip(head.tolist(), np.append(head[1:], len(doc)).tolist())))
            out = []
            for r, d, t in zip(batch.column(1).slice(n).to_pylist(), batch.column(2).slice(n).to_pylist(), batch.column(3).slice(n).cast(pa.binary()).to_pylist()):
                removed = spans = 0
                kept = t
                if r in known:
                    lo, hi = known[r]
                    b, e = begin[lo:hi], np.maximum.accumulate(end[lo:hi])
                    fresh = np.concatenate([[True], b[1:] > e[:-1]])
                    b, e = b[fresh], e[np.append(np.flatnonzero(fresh)[1:], hi - lo) - 1]
                    e = np.minimum(e, len(t))  # an equal text of a smaller document covers all
                    removed, spans = int((e - b).sum()), len(b)
                    kept = b"".join(t[x:y] for x, y in zip([0, *e.tolist()], [*b.tolist(), len(t)]))
                out.append((d, len(t), removed, spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if keep_text else ()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + ([pa.binary()] if keep_text else [])
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if keep_text else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, schema)
