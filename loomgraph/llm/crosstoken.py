"""Operator 12: alignment of two tokenizers' tokens of the same text, by lockstep merging.

A is a byte-level BPE over space+text, B a SentencePiece model that adds the space itself.  Both give token ends in
bytes.  All documents of a batch are merged at once: one NumPy state vector holds a pointer into A and one into B for
each lane, every step emits a link of each lane's two tokens and moves the pointer whose token ends first (both, and a
cut, where they end together), and finished lanes are compacted away.  A long document is several lanes: it is
divided where a token of A and one of B are seen to end together, so the steps of a batch stay few.

A batch of about BATCH bytes becomes one row: its documents with their counts, and the id pairs of its links, each
once, which documents refer to by place.  Corpus-wide counts are an aggregation over the batches' pairs, joined back
to them by pair; no count is broadcast, and a very frequent pair has one row a batch.

Null text, empty text, and text whose joined A or B bytes aren't space+text (as one with U+2581): no tokens, zeros
and an empty hash.  Repeated rows are aligned each.  Other columns aren't read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared, tokens, words

#: Bytes of text that one row of the written table holds, bytes that are merged at a time, and A tokens of a lane.
BATCH, CHUNK, LANE = 8 << 20, 2 << 20, 256
#: Words whose ids a worker remembers; beyond it starts anew.
CACHE = 600_000
_CUTS = bytes([0x20, 0x0A])
_KINDS = words.mix(np.array([21, 22], np.uint64))
_PAIR = 1 << 32


class Two:
    """Ids of both tokenizers.  Words between single spaces and newlines are encoded once; other texts go whole."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = tokens.Encoder(path_a, True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = {c: b for b, c in self.a.letters.items()}
        self.bytes_a = _Table([bytes(shown[c] for c in t) if t is not None and all(c in shown for c in t) else (t or "").encode() for t in map(self.a.tokenizer.id_to_token, range(self.a.vocab_size))])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = _Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # no piece reaches over a space before a word, or over a newline: the merges of a text are those of its words
        self.by_word = self.a.by_word and not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) and self._plain()
        self._reset()

    def _plain(self) -> bool:
        """Whether B takes a text as it is: its pieces of odd texts are their bytes."""
        odd = "ﬁ Å  é 　x"
        return b"".join(self.bytes_b.items[i] for i in self.b.encode(odd)) == b" " + odd.encode()

    def _reset(self) -> None:
        self.known: dict[int, int] = {}
        self.pool_a, self.pool_b, self.at_a, self.at_b = array("I"), array("I"), array("q", [0]), array("q", [0])

    def _add(self, keys: list[int], texts: list[str]) -> list[int]:
        """Takes up new words, which begin with the newline before them if there is one; B's own space in front of it isn't theirs."""
        for key, text, b in zip(keys, texts, self.b.encode(texts, num_threads=1)):
            newline = text[0] == "\n"
            self.pool_a.extend(self.a._piece("\n") + self.a._split(text[1:]) if newline else self.a._split(text, True))
            self.pool_b.extend(b[1:] if newline else b)
            self.known[key] = len(self.at_a) - 1
            self.at_a.append(len(self.pool_a))
            self.at_b.append(len(self.pool_b))
        return [self.known[key] for key in keys]

    def whole(self, text: str) -> tuple[list[int], list[int]]:
        return self.a.whole(" " + text), self.b.encode(text, num_threads=1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids of all texts one after another and each text's first (n+1), and the same of B; nothing for empty texts."""
        n = len(offsets) - 1
        slow = self.a._slow(data, offsets) if self.by_word else offsets[1:] > offsets[:-1]
        if len(self.known) > CACHE:
            self._reset()
        starts, ends, hashes, first = words.split_words(data, offsets, _CUTS, fold=False)
        doc = np.repeat(np.arange(n), np.diff(first))
        keep = ~slow[doc]
        starts, ends, hashes, doc = starts[keep], ends[keep], hashes[keep], doc[keep]
        newline = np.zeros(len(starts), np.int64)
        inner = starts > offsets[doc]
        newline[inner] = data[starts[inner] - 1] == 0x0A
        uniq, sample, inverse = np.unique(hashes ^ _KINDS[newline], return_index=True, return_inverse=True)
        slots = list(map(self.known.get, uniq.tolist()))
        new = [i for i, slot in enumerate(slots) if slot is None]
        texts = [data[starts[w] - newline[w] : ends[w]].tobytes().decode() for w in sample[new].tolist()]
        for i, slot in zip(new, self._add(uniq[new].tolist(), texts) if new else []):
            slots[i] = slot
        slots = np.array(slots, np.int64)[inverse] if len(slots) else np.empty(0, np.int64)
        whole = {i: self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()) for i in np.flatnonzero(slow).tolist()}
        out = []
        for side, (pool, at) in enumerate(((self.pool_a, self.at_a), (self.pool_b, self.at_b))):
            at = np.array(at, np.int64)
            size = np.diff(at)[slots]
            count = np.bincount(doc, size, n).astype(np.int64)
            ids = np.array(pool, np.uint32)[words.ragged(at[slots], size)]
            if whole:
                cut = np.cumsum(count)[:-1]
                parts = np.split(ids, cut)
                for i, two in whole.items():
                    parts[i], count[i] = np.array(two[side], np.uint32), len(two[side])
                ids = np.concatenate(parts)
            out += [ids, np.concatenate([[0], np.cumsum(count)])]
        return tuple(out)


class _Table:
    """The bytes of every id."""

    def __init__(self, items: list[bytes]):
        self.items = items
        self.size = np.array([len(x) for x in items], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(items), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[words.ragged(self.start[ids], self.size[ids])]


@lru_cache(maxsize=1)
def two(path_a: str, path_b: str) -> Two:
    """The worker process's tokenizers; kept from task to task."""
    return Two(path_a, path_b)


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 0x20, np.uint8)
    sizes = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), sizes)] = data
    return out, offsets + np.arange(n + 1)


def _faithful(table: _Table, ids: np.ndarray, first: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text's ids join to its bytes."""
    ends = np.concatenate([[0], np.cumsum(table.size[ids])])[first]
    good = np.diff(ends) == np.diff(offsets)
    joined = table.joined(ids)
    if good.all() and len(joined) == len(data):
        if np.array_equal(joined, data):
            return good
    for i in np.flatnonzero(good):
        good[i] = np.array_equal(joined[ends[i] : ends[i + 1]], data[offsets[i] : offsets[i + 1]])
    return good


def lanes(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, size: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where lanes begin and stop in A and in B: at the documents' ends, and after about every *size* A tokens if a B token ends there too.

    *end_a*, *end_b*: ends in bytes over all documents, ascending.
    """
    tries = np.arange(size, len(end_a), size)
    for _ in range(8):  # the next token whose end B shares, within a few; a lane without one is just longer
        at = np.searchsorted(end_b, end_a[tries])
        at[at == len(end_b)] = 0
        miss = end_b[at] != end_a[tries] if len(end_b) else np.ones(len(tries), bool)
        if not miss.any():
            break
        tries = np.where(miss, np.minimum(tries + 1, len(end_a) - 1), tries)
    if len(tries):
        at = np.searchsorted(end_b, end_a[tries])
        at[at == len(end_b)] = 0
        good = end_b[at] == end_a[tries]
        extra_a, extra_b = tries[good] + 1, at[good] + 1
    else:
        extra_a = extra_b = np.empty(0, np.int64)
    full = np.flatnonzero(np.diff(first_a))
    from_a = np.unique(np.concatenate([first_a[full], extra_a]))
    from_b = np.unique(np.concatenate([first_b[full], extra_b]))
    keep = from_a < len(end_a)
    from_a, from_b = from_a[keep], from_b[keep]
    return from_a, np.append(from_a[1:], len(end_a)), from_b, np.append(from_b[1:], len(end_b))


def lockstep(end_a: np.ndarray, end_b: np.ndarray, from_a: np.ndarray, to_a: np.ndarray, from_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (places in A, places in B) and the places in A after which both sides end, of all lanes, merged side by side."""
    a, b, stop = from_a.copy(), from_b.copy(), to_a
    linked_a, linked_b, cuts = [], [], []
    while len(a):
        linked_a.append(a)
        linked_b.append(b)
        x, y = end_a[a], end_b[b]
        step_a, step_b = x <= y, y <= x
        cuts.append(a[step_a & step_b])
        a, b = a + step_a, b + step_b
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    if not linked_a:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(linked_a), np.concatenate(linked_b), np.concatenate(cuts)


@lru_cache(maxsize=1)
def _digits(n: int) -> _Table:
    return _Table([str(i).encode() for i in range(n)])


def _written_groups(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The text ``a1,a2|b1;a3|b2,b3;`` of all groups, and where each group's text begins (groups + 1)."""
    count_a, count_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_a, before_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    place_a = np.arange(len(ids_a)) + before_b[group_a]  # B tokens of earlier groups stand before an A token
    place_b = np.arange(len(ids_b)) + before_a[group_b] + count_a[group_b]
    total = len(ids_a) + len(ids_b)
    ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    last_a, last_b = before_a + count_a - 1, before_b + count_b - 1
    mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
    table = _digits(max(1 << 16, 1 << int(ids.max()).bit_length()) if total else 1 << 16)
    size = table.size[ids]
    ends = np.cumsum(size + 1)
    out = np.empty(int(ends[-1]) if total else 0, np.uint8)
    out[words.ragged(ends - size - 1, size)] = table.joined(ids)
    out[ends - 1] = mark
    return out, np.concatenate([[0], ends[place_b[last_b]]]) if groups else np.zeros(1, np.int64)


def align(tokenizers: Two, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | list]:
    """Of all texts: n_a, n_b, n_groups, n_links, groups_sha256, and links as codes (A id * 2**32 + B id) with each text's first (n+1)."""
    n = len(offsets) - 1
    ids_a, first_a, ids_b, first_b = tokenizers.encode(data, offsets)
    spaced, at = _spaced(data, offsets)
    good = _faithful(tokenizers.bytes_a, ids_a, first_a, spaced, at) & _faithful(tokenizers.bytes_b, ids_b, first_b, spaced, at) & (np.diff(offsets) > 0)
    if not good.all():
        keep = good[np.repeat(np.arange(n), np.diff(first_a))], good[np.repeat(np.arange(n), np.diff(first_b))]
        ids_a, ids_b = ids_a[keep[0]], ids_b[keep[1]]
        first_a, first_b = (np.concatenate([[0], np.cumsum(np.where(good, np.diff(f), 0))]) for f in (first_a, first_b))
    end_a, end_b = np.cumsum(tokenizers.bytes_a.size[ids_a]), np.cumsum(tokenizers.bytes_b.size[ids_b])
    from_a, to_a, from_b, _ = lanes(end_a, end_b, first_a, first_b)
    link_a, link_b, cuts = lockstep(end_a, end_b, from_a, to_a, from_b)
    order = np.argsort(link_a + link_b, kind="stable")  # along the texts: every step moves at least one of the two
    link_a, link_b = link_a[order], link_b[order]
    cut = np.zeros(len(ids_a) + 1, np.int64)
    cut[cuts + 1] = 1
    group_a = np.cumsum(cut)[:-1] if len(ids_a) else np.empty(0, np.int64)
    groups = len(cuts)
    group_b = np.searchsorted(end_a[np.sort(cuts)], end_b) if groups else np.empty(0, np.int64)
    text, begins = _written_groups(ids_a, ids_b, group_a, group_b, groups)
    group_first = np.concatenate([group_a, [groups]])[first_a]
    hashes = [hashlib.sha256(text[begins[x] : begins[y] - 1]).hexdigest() if y > x else "" for x, y in zip(group_first[:-1].tolist(), group_first[1:].tolist())]
    links_first = np.searchsorted(link_a, first_a)
    return {
        "n_a": np.diff(first_a), "n_b": np.diff(first_b), "n_groups": np.diff(group_first), "n_links": np.diff(links_first), "groups_sha256": hashes,
        "codes": ids_a[link_a].astype(np.int64) * _PAIR + ids_b[link_b], "links_first": links_first,
    }


DOCUMENT = "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,places:array<int>,times:array<int>>"


def batches(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows (batch, docs, pairs, links): documents with the places of their pairs, and each pair of the batch with its links."""
    spark = docs.sparkSession
    shared.tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(parts):
        tokenizers = two(path_a, path_b)
        for table in words.regroup(parts, "text", BATCH):
            names = table.column("doc_id").combine_chunks()
            found = []
            for chunk in words.regroup(table.to_batches(), "text", CHUNK):
                found.append(align(tokenizers, *words.column_bytes(chunk.column("text"))))
            codes = np.concatenate([f["codes"] for f in found])
            pairs, place = np.unique(codes, return_inverse=True)
            links = np.bincount(place, minlength=len(pairs))
            sizes = np.concatenate([f["n_links"] for f in found])
            doc = np.repeat(np.arange(len(sizes)), sizes)
            each, times = np.unique(doc * np.int64(max(1, len(pairs))) + place, return_counts=True)
            first = np.searchsorted(each, np.arange(len(sizes) + 1) * np.int64(max(1, len(pairs))))
            flat = lambda values: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.astype(np.int32)))
            whole = lambda name: pa.array(np.concatenate([f[name] for f in found]), pa.int64())
            inside = pa.StructArray.from_arrays(
                [pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names, whole("n_a"), whole("n_b"), whole("n_groups"), whole("n_links"), pa.array([h for f in found for h in f["groups_sha256"]], pa.string()),
                 flat(each % max(1, len(pairs))), flat(times)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times"])
            one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
            yield pa.RecordBatch.from_arrays([one(inside), one(pa.array(pairs)), one(pa.array(links.astype(np.int64)))], ["docs", "pairs", "links"])

    out = rows.mapInArrow(run, f"docs array<{DOCUMENT}>, pairs array<bigint>, links array<bigint>")
    return shared.written(out.withColumn("batch", F.expr("uuid()")), "aligned")


def pair_counts(held: DataFrame) -> DataFrame:
    """Rows (pair, n, best) of the corpus: the links of each id pair, and whether no pair of its B id has more."""
    each = held.select(F.explode(F.arrays_zip("pairs", "links")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("n"))
    each = shared.written(each, "pair-counts")
    most = each.groupBy((F.col("pair") % _PAIR).alias("b")).agg(F.max("n").alias("most"))
    return each.join(most, F.col("pair") % _PAIR == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summary(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document: its tokens, groups and links, and what the corpus-wide counts of its links' pairs say."""
    held = batches(docs, path_a, path_b)
    mine = held.select("batch", F.posexplode("pairs").alias("place", "pair")).join(pair_counts(held), "pair")
    known = mine.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", "n", "best"))).alias("known"))  # as many as a batch has pairs
    rows = held.select("batch", "docs").join(known, "batch", "left").select("docs", F.col("known.n").alias("n"), F.col("known.best").alias("best"))

    def run(parts):
        for part in parts:
            for at in range(part.num_rows):
                inside = part.column(0)[at].values
                n = np.asarray(part.column(1)[at].values, np.int64) if part.column(1)[at].is_valid else np.empty(0, np.int64)
                best = np.asarray(part.column(2)[at].values.cast(pa.int64()), np.int64) if part.column(2)[at].is_valid else n
                lists, times = inside.field("places"), np.asarray(inside.field("times").flatten(), np.int64)
                places, sizes = np.asarray(lists.flatten(), np.int64), np.asarray(pc.list_value_length(lists), np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                sums = []
                for value in (best, n):
                    total = np.zeros(len(sizes), np.int64)
                    np.add.at(total, doc, value[places] * times)
                    sums.append(pa.array(total))
                keep = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
                yield pa.RecordBatch.from_arrays([inside.field(k) for k in keep] + sums + [inside.field("groups_sha256")], [*keep, "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
