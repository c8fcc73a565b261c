"""Operator 5: Katz back-off language model over words, of any order; trigrams by default.

Tokens are a text's words, lower-cased in A-Z, and one end.  P(w | h) is the Good-Turing discounted
relative frequency if (h, w) occurs in training, and else alpha(h) P(w | h'), where h' is h without its
oldest word; each order has discounts of its own.  The recursion ends with the discounted unigrams, whose
left-over is the probability of the one class of unknown words.  alpha(h) spreads just what the discounts
leave over the words that don't follow h, so every distribution, also that of the unigrams with the
unknown class, sums to exactly one.  Histories reach over a text's start as start marks.  Where no count
of h is discounted, its counts are taken over c(h) + 1; without any training text every P is 1.

Counts live in a table for each order, partitioned by bucket of the word or of the history.  Texts are
handled in batches of about TEXT bytes, whose word numbers are files in the shared folder.  For each order, from
the lowest, a batch asks each bucket for what it needs as one row of packed numbers, with its own counts
to be added and the probabilities of the next lower order (as counts of its words, if these are the unigrams; not where the
bucket can add these up itself, as it holds all n-grams of a nearest word that isn't split), and gets one row back: ids and counts of
its distinct words, then counts of its distinct n-grams and each history's sums.  From these it evaluates
the order once, at what isn't in training, as nothing else backs off, and at n-grams of split words, whose buckets want
it.  What the next order backs off to is kept in a file.  So an n-gram costs a few
bytes in a shuffle, once for each batch and not for each occurrence; a frequent one is added up inside
the batches beforehand.  A history with more than a bucket's share of all tokens is split over several
buckets by its successor; what is left of it for the driver is one row of sums for each part, a few for each bucket.

Words are named by 64-bit hashes until they have ids of 64 bits; with n distinct words the chance that any
two share a hash is below n**2 / 2**64.  Null text is empty: only the end.  A null id is in training.
Repeated rows count and are scored each.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import files, shared, words

#: Bytes of text in a batch.
TEXT = 12 << 20
#: Counts up to this are discounted.
K = 5
END, START = np.uint64(0xE2D0E2D0E2D0E2D1), np.uint64(0xFFFFFFFFFFFFFFFF)
#: The order of the model: words of its longest n-grams.
ORDER = 3
_ROWS = "kind int, batch long, bucket int, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary"
_BLOBS = 5
_STATE, _WORD, _WORDS, _GRAM, _GRAMS, _STAT, _SPLIT, _HOT = range(8)


def pack(values: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, up to the highest that isn't 0 everywhere, compressed."""
    values = np.ascontiguousarray(values)
    size = values.dtype.itemsize
    whole = values.view(f"u{size}")
    width = max(1, (int(whole.max()).bit_length() + 7) // 8) if len(whole) else 1
    each, planes = values.view(np.uint8).reshape(-1, size), np.empty((width, len(values)), np.uint8)
    for i in range(width):
        planes[i] = each[:, i]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    for i, plane in enumerate(planes):
        out[:, i] = plane
    return out.view(kind).reshape(-1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * _BLOBS
    rows = [(*r, *[None] * (3 + _BLOBS - len(r))) for r in rows]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "batch", "bucket"] + [f"b{i}" for i in range(_BLOBS)])


def _grouped(batches, key: int):
    """Rows of sorted batches, by the column *key*."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[key] != last:
                yield last, held
                held = []
            last = row[key]
            held.append(row)
    if held:
        yield last, held


def _sorted(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of numbers that aren't negative, and where in it each value begins."""
    name = name.astype(np.uint64)
    bits = np.uint64(max(1, len(name) - 1).bit_length())
    if not len(name) or int(name.max()).bit_length() + int(bits) > 64:
        order = np.argsort(name, kind="stable")
        return order, _heads(name[order])
    # number and place in one value: values are sorted much faster than places
    keys = np.sort((name << bits) | np.arange(len(name), dtype=np.uint64))
    return (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), _heads(keys >> bits)


def _distinct(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each value, in order of the values, and the number of each place's value."""
    order, heads = _sorted(name)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.repeat(np.arange(len(heads)), _lengths(heads, len(order)))
    return order[heads], inverse


class GoodTuring:
    """Discounts by counts of counts n[1] .. n[K + 1]; a ratio that isn't between 0 and 1 gives way to absolute discounting."""

    def __init__(self, n: list[int]):
        self.ratio = np.ones(K + 1)
        n = [0, *n]
        high = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        part = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - high) / (1 - high) if n[r] and high != 1 else 0.0
            self.ratio[r] = d if 0 < d < 1 else 1 - min(part, 0.999) / r

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= K, self.ratio[np.minimum(counts, K)], 1.0)


class Unigrams:
    """P(w) by training count: discounted counts of the known words, and the rest for the class of the unknown."""

    def __init__(self, n_tokens: int, n_types: int, n: list[int]):
        self.n_tokens, self.n_types = n_tokens, n_types
        self.turing = GoodTuring(n)
        left = float(sum(n[r - 1] * r * (1 - self.turing.ratio[r]) for r in range(1, K + 1)))
        self.total = float(n_tokens) if left > 0 else n_tokens + 1.0
        self.unknown = (left if left > 0 else 1.0) / self.total

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.turing.discounted(counts) / self.total, self.unknown)


class History:
    """Back-off weight of histories from their sums: c, n[1..K] and the sum of P over their successors."""

    def __init__(self, turing: GoodTuring, c: np.ndarray, n: np.ndarray, followed: np.ndarray):
        left = (n * np.arange(1, K + 1) * (1 - turing.ratio[1:])).sum(axis=1)
        none = left <= 0
        self.total = np.where(none, c + 1.0, c)
        left = np.where(none, 1.0, left) / np.maximum(self.total, 1)
        self.alpha = np.where(c > 0, left / np.maximum(1 - followed, 1e-300), 1.0)


def save(folder: str, arrays: dict[str, np.ndarray]) -> bytes:
    """A batch's arrays as a file in the shared folder; its URI."""
    blobs = {k: pack(v) for k, v in arrays.items()}
    head = json.dumps({k: [arrays[k].dtype.str, len(blobs[k])] for k in arrays}).encode()
    uri, out = files.create(folder, "batch")
    with out:
        out.write(struct.pack("<I", len(head)) + head + b"".join(blobs.values()))
    return uri.encode()


def load(uri: bytes) -> dict[str, np.ndarray]:
    with files.opened(uri.decode()) as file:
        raw = file.read()
    (size,) = struct.unpack_from("<I", raw)
    at, out = 4 + size, {}
    for name, (kind, length) in json.loads(raw[4 : 4 + size]).items():
        out[name] = unpack(raw[at : at + length], kind)
        at += length
    return out


def _batches(docs: DataFrame, text: int, folder: str) -> DataFrame:
    """One row for each batch, naming its file: ids, flags (null id, held out), token counts, tokens as numbers of the batch's words, their hashes."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for n, table in enumerate(words.regroup(batches, "text", text)):
            key = table["doc_id"].combine_chunks()
            _, _, hashes, first = words.split_words(*words.column_bytes(table["text"]))
            count = np.diff(first) + 1
            ends = np.cumsum(count) - 1
            stream = np.full(len(hashes) + len(count), END, np.uint64)
            inner = np.ones(len(stream), bool)
            inner[ends] = False
            stream[inner] = hashes
            uniq, inverse, times = np.unique(stream, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            flags = key.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) + 2 * table["held"].to_numpy(zero_copy_only=False).astype(np.uint8)
            uri = save(folder, {"ids": key.fill_null(0).to_numpy(zero_copy_only=False), "flags": flags, "count": count.astype(np.uint32), "tokens": place[inverse], "hashes": uniq[order]})
            yield _batch([(_STATE, (part << 24) | n, -1, uri)])

    return docs.mapInArrow(run, _ROWS)


def _word_order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers by bucket, and where each bucket ends."""
    bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def numbered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first of equal rows of the columns, in order of the first column, then the next, and each row's number in that order."""
    columns = [c + np.uint64(1) for c in columns]  # START is 0
    first, out = _distinct(columns[0])
    for column in columns[1:]:
        values, inverse = _distinct(column)
        first, out = _distinct(out * max(1, len(values)) + inverse)
    return first, out


class Batch:
    """A batch's tokens as numbers of its words, which are in order of their ids."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.count = self.count.astype(np.int64)
        self.starts = np.cumsum(self.count) - self.count
        self.held = self.flags >= 2
        self.train = np.repeat(~self.held, self.count)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.count)
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each token's k-gram, in order of its history's, the first token of each, and its history's number, 0 at a text's start."""
        if k == 1:
            return self.tokens.astype(np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if k not in self.known:
            history = np.zeros(len(self.tokens), np.int64)
            history[1:] = self.grams(k - 1)[0][:-1] + 1
            history[self.starts] = 0
            first, inverse = _distinct(history * np.int64(len(self.word_ids)) + self.tokens)
            self.known[k] = inverse, first, history[first]
        return self.known[k]

    def nearest(self, at: np.ndarray) -> np.ndarray:
        """The number of the word before each of the tokens *at*; one more than the last word's before a text's start."""
        return np.where(self.place[at] > 0, self.tokens[at - 1], len(self.word_ids))

    def backing(self, k: int) -> np.ndarray:
        """The k-grams that have a token that isn't in training: no other tokens back off to them."""
        inverse, first, _ = self.grams(k)
        return np.flatnonzero(np.bincount(inverse[~self.train], minlength=len(first)))

    def histories(self, at: np.ndarray, k: int) -> list[np.ndarray]:
        """Ids of the k - 1 words before the tokens *at*, the nearest first; START before a text's start."""
        out = []
        for back in range(1, k):
            column = np.full(len(at), START, np.uint64)
            inside = self.place[at] >= back
            column[inside] = self.word_ids[self.tokens[at[inside] - back]]
            out.append(column)
        return out


def _name(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of histories, by which they are dealt out."""
    out = np.full(len(columns[0]), 0x51AB, np.uint64)
    with np.errstate(over="ignore"):
        for column in columns:
            out = words.mix(out * np.uint64(0xD6E8FEB86659FD93) + column)
    return out


class Hot:
    """Histories that are split: rows (ids of the words, parts)."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int]]):
        self.ids = np.array([r[0] for r in rows], np.uint64).reshape(len(rows), len(rows[0][0]) if rows else 0)
        self.parts = np.array([r[1] for r in rows], np.uint64)
        if len(rows):
            names = _name(list(self.ids.T))
            order = np.argsort(names)
            self.names, self.ids, self.parts = names[order], self.ids[order], self.parts[order]

    def find(self, columns: list[np.ndarray]) -> np.ndarray:
        """The row of each history, or -1."""
        if not len(self.parts):
            return np.full(len(columns[0]), -1)
        names = _name(columns)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        hit = self.names[at] == names
        for c, column in enumerate(columns):
            hit &= self.ids[at, c] == column
        return np.where(hit, at, -1)


def _buckets(columns: list[np.ndarray], w: np.ndarray, buckets: int, hot: Hot, words_: Hot) -> np.ndarray:
    """The bucket of each n-gram.

    It is that of the nearest word, so that a bucket names few of these.  A word with more than a bucket's share
    is split by the words before it, and a history with more than that by its successor.
    """
    part = lambda of, seed, parts: words.mix(of + np.uint64(seed)) % parts
    sub = np.zeros(len(w), np.uint64)
    with np.errstate(over="ignore"):
        if len(columns) > 1:
            at = words_.find(columns[:1])
            found = at >= 0
            sub[found] = part(_name([c[found] for c in columns[1:]]), 7, words_.parts[at[found]])
        at = hot.find(columns)
        found = at >= 0
        sub[found] += np.uint64(1 << 32) + part(w[found], 99, hot.parts[at[found]])
        return (words.mix(_name(columns[:1]) + sub * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def _heads(h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)


def _lengths(heads: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(heads, n))


def _histogram(counts: np.ndarray) -> np.ndarray:
    return np.bincount(counts[(counts > 0) & (counts <= K + 1)], minlength=K + 2)[1:].astype(np.int64)


def _columns(columns: list[np.ndarray]) -> bytes:
    return pack(np.concatenate(columns) + np.uint64(1))  # START is 0


def _coded(values: np.ndarray) -> bytes:
    """Values of which many are equal; nothing if all are 0."""
    if not values.any():
        return b""
    uniq, inverse = np.unique(values, return_inverse=True)
    codes = pack(uniq)
    return struct.pack("<I", len(codes)) + codes + pack(inverse.astype(np.uint32))


class Order:
    """The exchange of one order: what a batch asks, what a bucket tells, and what a batch makes of it."""

    def __init__(self, k: int, buckets: int, hot: Hot, words_: Hot, share: float, below: GoodTuring | None = None, unigrams: Unigrams | None = None):
        self.k, self.buckets, self.hot, self.words, self.share, self.below, self.unigrams = k, buckets, hot, words_, share, below, unigrams

    def whole(self, columns: list[np.ndarray]) -> np.ndarray:
        """Histories whose n-grams, and those of their shorter histories, lie in one bucket: their nearest word isn't split."""
        return self.words.find(columns[:1]) < 0 if self.below is not None else np.zeros(len(columns[0]), bool)

    def lower(self, names: list[np.ndarray], h: np.ndarray, w: np.ndarray, total: np.ndarray) -> np.ndarray:
        """P of the next lower order for n-grams in training, from their counts: histories by name, each n-gram's history, word and count."""
        shorter = numbered(names[: self.k - 2])[1][h]
        sample, gram = _distinct(shorter * (int(w.max()) + 1) + w)
        count = np.bincount(gram, weights=total).astype(np.int64)
        of = shorter[sample]
        sums = np.stack([np.bincount(of, weights=count)] + [np.bincount(of, weights=count == r) for r in range(1, K + 1)], axis=1).astype(np.int64)
        history = History(self.below, sums[:, 0], sums[:, 1:], np.zeros(len(sums)))
        return (self.below.discounted(count) / np.maximum(history.total, 1)[of])[gram]

    def of_batch(self, batch: Batch) -> tuple[np.ndarray, ...]:
        """N-grams of the tokens, the first token of each and its history; n-grams by bucket, then by the history's nearest word, then as they were; where each bucket ends."""
        inverse, first, before = batch.grams(self.k)
        near, names = batch.nearest(first), np.append(batch.word_ids, START)
        # only words that may be split have to be looked at by n-gram
        single = _buckets([names], names, self.buckets, Hot([]), Hot([]))
        odd = self.words.find([names]) >= 0
        if len(self.hot.parts):
            odd |= np.isin(names, self.hot.ids[:, 0])
        bucket = single[near]
        at = np.flatnonzero(odd[near])
        bucket[at] = _buckets(batch.histories(first[at], self.k), batch.word_ids[batch.tokens[first[at]]], self.buckets, self.hot, self.words)
        order, _ = _sorted(bucket * len(names) + near)
        return inverse, first, before, order, np.append(0, np.cumsum(np.bincount(bucket, minlength=self.buckets)))

    def needs(self, batch: Batch) -> np.ndarray:
        """The tokens whose probability of the next lower order is asked with: the first of each n-gram that its bucket can't add up."""
        first = batch.grams(self.k)[1]
        return first[~self.whole([np.append(batch.word_ids, START)])[batch.nearest(first)]]

    def ask(self, number: int, batch: Batch, lower: np.ndarray | None) -> list[tuple]:
        """Rows for the buckets; *lower* is P of the next lower order by token, needed at those of :meth:`needs`, and not at all with unigrams."""
        inverse, first, before, order, cut = self.of_batch(batch)
        count = np.bincount(inverse[batch.train], minlength=len(first))
        value = np.zeros(len(first))
        if self.unigrams is None:
            # of n-grams that don't occur in training here nobody needs the lower probability
            at = inverse[self.needs(batch)]
            value[at] = np.where(count[at] > 0, lower[first[at]], 0.0)
        out = []
        for b in range(self.buckets):
            mine = order[cut[b] : cut[b + 1]]
            if len(mine):
                heads = _heads(before[mine])
                head = struct.pack("<II", len(heads), len(mine)) + pack(_lengths(heads, len(mine)))
                w = batch.tokens[first[mine]]
                below = _coded(value[mine]) if self.unigrams is None else pack(batch.word_counts[np.unique(w)])
                out.append((_GRAM, number, b, head, _columns(batch.histories(first[mine[heads]], self.k)), pack(batch.word_ids[w]), pack(count[mine]), below))
        return out

    def tell(self, bucket: int, rows: list[tuple]) -> list[tuple]:
        sizes, heads, ws, counts, repeats = [], [], [], [], []
        for r in rows:
            sizes.append(struct.unpack_from("<II", r[3]))
            repeats.append(unpack(r[3][8:], "i8"))
            heads.append(unpack(r[4], "u8").reshape(self.k - 1, -1) - np.uint64(1))
            ws.append(unpack(r[5], "u8"))
            counts.append(unpack(r[6], "i8"))
        columns = list(np.concatenate(heads, axis=1))
        sample, of_head = numbered(columns)
        names = [c[sample] for c in columns]
        w = np.concatenate(ws)
        sample, of_word = _distinct(w)
        words_ = w[sample]
        label = np.repeat(of_head, np.concatenate(repeats)) * len(words_) + of_word
        sample, inverse = _distinct(label)
        h, w = np.divmod(label[sample], len(words_))
        total = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        lower, of_unigram, at = np.zeros(len(sample)), np.zeros(len(words_), np.int64), 0
        for r, (_, n) in zip(rows, sizes):
            # whoever tells a value tells the same
            if self.unigrams is not None:  # counts of the row's words, in order of their ids
                told = np.zeros(len(words_), bool)
                told[of_word[at : at + n]] = True
                of_unigram[told] = unpack(r[7], "i8")
            elif r[7]:
                (size,) = struct.unpack_from("<I", r[7])
                value = unpack(r[7][4 : 4 + size], "f8")[unpack(r[7][4 + size :], "u4")]
                told = np.flatnonzero(value)
                lower[inverse[at + told]] = value[told]
            at += n
        if self.unigrams is not None:
            lower = self.unigrams.p(of_unigram)[w]
        own = self.whole(names)[h]
        if own.any():
            lower = np.where(own, self.lower(names, h, w, total), lower)
        begin = _heads(h)
        seen = total > 0
        sums = np.zeros((len(begin), K + 1), np.int64)
        sums[:, 0] = np.add.reduceat(total, begin)
        for r in range(1, K + 1):
            sums[:, r] = np.add.reduceat((total == r).astype(np.int64), begin)
        followed = np.add.reduceat(np.where(seen, lower, 0.0), begin)
        out, row_at, head_at = [], 0, 0
        for r, lengths, (n_heads, n) in zip(rows, repeats, sizes):
            own = of_head[head_at : head_at + n_heads]
            told = total[inverse[row_at : row_at + n]]
            # who backs off from a history needs what follows it
            backs = np.add.reduceat((told == 0).astype(np.int64), np.cumsum(lengths) - lengths) > 0
            n_of = sums[own].T
            n_of[1:] = np.where(backs, n_of[1:], np.minimum(n_of[1:], 1))
            out.append((_GRAMS, r[1], bucket, pack(told), pack(n_of.reshape(-1)), pack(followed[own[backs]]), pack(backs)))
            row_at, head_at = row_at + n, head_at + n_heads
        model = np.flatnonzero(seen)
        runs = _heads(h[model])
        of_w = words_[w]
        out.append((_GRAM, -1, bucket, _columns([c[h[model][runs]] for c in names]), pack(_lengths(runs, len(model))), pack(of_w[model]), pack(total[model])))
        out.append((_STAT, -1, bucket, _histogram(total).tobytes()))
        for x in np.flatnonzero(self.hot.find(names) >= 0):
            out.append((_SPLIT, -1, bucket, np.array([c[x] for c in names], np.uint64).tobytes(), sums[x].tobytes(), np.float64(followed[x]).tobytes()))
        large = np.flatnonzero(total > self.share)  # histories of the next order; a bucket has few
        if len(large):
            out.append((_HOT, -1, bucket, np.stack([of_w[large], *[c[h[large]] for c in names]], axis=1).astype(np.uint64).tobytes(), total[large].tobytes()))
        return out

    def learn(self, batch: Batch, replies: list[tuple], lower: np.ndarray, turing: GoodTuring, whole: tuple[Hot, np.ndarray, np.ndarray], at: np.ndarray | None = None) -> np.ndarray:
        """P of the tokens *at*, of all without them, by this order or backed off to *lower*, their P by the order below; only tokens that aren't in training back off."""
        inverse, first, before, order, cut = self.of_batch(batch)
        total, c, alpha = np.zeros(len(first), np.int64), np.zeros(len(first)), np.ones(len(first))
        hot, hot_sums, hot_followed = whole
        for r in replies:
            mine = order[cut[r[2]] : cut[r[2] + 1]]
            total[mine] = unpack(r[3], "i8")
            heads = _heads(before[mine])
            sums, followed = unpack(r[4], "i8").reshape(K + 1, -1).T, np.zeros(len(heads))
            followed[unpack(r[6], bool)] = unpack(r[5], "f8")
            if len(hot.parts):
                split = hot.find(batch.histories(first[mine[heads]], self.k))
                sums, known = sums.copy(), split >= 0
                sums[known], followed[known] = hot_sums[split[known]], hot_followed[split[known]]
            history = History(turing, sums[:, 0], sums[:, 1:], followed)
            each = _lengths(heads, len(mine))
            c[mine], alpha[mine] = np.repeat(np.maximum(history.total, 1), each), np.repeat(history.alpha, each)
        direct = turing.discounted(total) / np.maximum(c, 1)
        gram = inverse if at is None else inverse[at]
        p, back = direct[gram], np.flatnonzero(total[gram] == 0)
        p[back] = alpha[gram[back]] * lower[back]
        return p


def train_and_score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, batch_bytes: int = TEXT, tables: dict | None = None) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: Column, true for documents that aren't learned from.  tables: gets the count tables, by order.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    shared.tune(spark)
    parts = shared.partitions(spark)
    buckets = 2 * parts
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    folders = [shared.new_path(spark, "katz-files") for _ in range(2)]
    states = shared.written(_batches(plain, batch_bytes, folders[0]), "katz-batches")

    def by(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(parts, key).sortWithinPartitions(key, "kind", "bucket", "batch")

    def each_row(f):
        def run(batches):
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    yield _batch(f(row))

        return run

    def each_group(key: int, f):
        def run(batches):
            for name, rows in _grouped(batches, key):
                yield _batch(f(name, rows))

        return run

    # words: their training counts and ids
    def ask_words(row):
        s = load(row[3])
        count = np.bincount(s["tokens"], weights=np.repeat(s["flags"] < 2, s["count"].astype(np.int64)), minlength=len(s["hashes"])).astype(np.int64)
        by_bucket, cut = _word_order(s["hashes"], buckets)
        return [(_WORD, row[1], b, pack(s["hashes"][mine]), pack(count[mine])) for b in range(buckets) if len(mine := by_bucket[cut[b] : cut[b + 1]])]

    def tell_words(bucket, rows):
        hashes = [unpack(r[3], "u8") for r in rows]
        counts = [unpack(r[4], "i8") for r in rows]
        uniq, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(uniq)).astype(np.int64)
        rank = np.empty(len(uniq), np.uint64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(uniq), dtype=np.uint64)
        ids = rank * np.uint64(buckets) + np.uint64(bucket)
        at, out = 0, []
        for r, x in zip(rows, hashes):
            mine = inverse[at : at + len(x)]
            at += len(x)
            out.append((_WORDS, r[1], bucket, pack(ids[mine]), pack(total[mine])))
        seen = total > 0
        out.append((_WORD, -1, bucket, pack(uniq[seen]), pack(ids[seen]), pack(total[seen])))
        out.append((_STAT, -1, bucket, np.array([total.sum(), seen.sum(), *_histogram(total)], np.int64).tobytes()))
        return out

    told = shared.written(by(states.mapInArrow(each_row(ask_words), _ROWS), "bucket").mapInArrow(each_group(2, tell_words), _ROWS), "katz-words", partition_by="kind")
    told_at = told._loomgraph_path
    told = told.select(*states.columns)
    stats = sum(np.frombuffer(r["b0"], np.int64) for r in told.filter(f"kind = {_STAT}").select("b0").collect()) + np.zeros(K + 3, np.int64)  # a row for each bucket
    n_tokens, n_types = int(stats[0]), int(stats[1])
    unigrams = Unigrams(n_tokens, n_types, stats[2:].tolist())
    share = max(1.0, n_tokens / buckets)
    n_docs = plain.filter("not held").count()

    def learn_words(number, rows):
        s = load(rows[0][3])
        by_bucket, cut = _word_order(s.pop("hashes"), buckets)
        s["word_ids"], s["word_counts"] = np.zeros(len(by_bucket), np.uint64), np.zeros(len(by_bucket), np.int64)
        for r in rows[1:]:
            mine = by_bucket[cut[r[2]] : cut[r[2] + 1]]
            s["word_ids"][mine] = unpack(r[3], "u8")
            s["word_counts"][mine] = unpack(r[4], "i8")
        # n-grams in order of the words' ids pack well
        by_id = np.argsort(s["word_ids"])
        place = np.empty(len(by_id), np.uint32)
        place[by_id] = np.arange(len(by_id), dtype=np.uint32)
        s["word_ids"], s["word_counts"], s["tokens"] = s["word_ids"][by_id], s["word_counts"][by_id], place[s["tokens"]]
        return [(_STATE, number, -1, save(folders[1], s))]

    learnt = shared.written(by(states.unionByName(told.filter(f"kind = {_WORDS}")), "batch").mapInArrow(each_group(1, learn_words), _ROWS), "katz-batches")
    shared.removed(spark, folders[0])
    shared.removed(spark, f"{told_at}/kind={_WORDS}")  # the batches have them
    shared.release(spark)
    if tables is not None:
        tables |= {1: told.filter(f"kind = {_WORD}"), "unigrams": unigrams}

    # words with more than a bucket's share are histories that are split; at most one for each bucket
    def large(row):
        ids = unpack(row[4], "u8")
        c = unpack(row[5], "i8")
        return [(_HOT, -1, row[2], ids[c > share].tobytes(), c[c > share].tobytes())] if (c > share).any() else []

    hot_rows = told.filter(f"kind = {_WORD}").mapInArrow(each_row(large), _ROWS) if order > 1 else None
    scored = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def result(batch: Batch, p: np.ndarray) -> pa.RecordBatch:
        known = batch.word_counts[batch.tokens]
        base = np.log10((known + 1) / (n_tokens + n_types + 1))
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(batch.ids, pa.int64(), mask=(batch.flags & 1).astype(bool)), "held_out": pa.array(batch.held),
            "n_tokens": pa.array(batch.count), "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), batch.starts)),
            "train_tokens": pa.array(np.full(len(batch.starts), n_tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, batch.starts)), "score": pa.array(np.add.reduceat(np.log10(p), batch.starts)),
        })

    if order == 1:

        def plainly(batches):
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    b = Batch(load(row[3]))
                    yield result(b, unigrams.p(b.word_counts)[b.tokens])

        return learnt.mapInArrow(plainly, scored)

    hot_words = None
    told_orders: list[tuple[Order, GoodTuring, tuple]] = []
    replies = None

    def begun(row: tuple, k: int) -> tuple[Batch, np.ndarray]:
        """A batch and P by order *k*, as it was kept, of its tokens that aren't in training."""
        b = Batch(load(row[3]))
        of_gram = unigrams.p(b.word_counts)
        if k > 1:
            of_gram = np.ones(len(b.grams(k)[1]))
            kept = load(row[4])
            of_gram[b.backing(k)] = kept["p"][kept["codes"]]
        p, held = np.ones(len(b.tokens)), np.flatnonzero(~b.train)
        p[held] = of_gram[b.grams(k)[0][held]]
        return b, p

    for k in range(2, order + 1):
        found = [((int(START),) * (k - 1), int(n_docs // share) + 1)] if n_docs > share else []
        for r in hot_rows.select("b0", "b1").collect():  # n-grams with more than a bucket's share of all tokens
            ids, c = np.frombuffer(r["b0"], np.uint64).reshape(-1, k - 1), np.frombuffer(r["b1"], np.int64)
            found += [(tuple(int(x) for x in i), int(n // share) + 1) for i, n in zip(ids, c)]
        hot_words = Hot(found) if k == 2 else hot_words
        step = Order(k, buckets, Hot(found), hot_words, share, *((told_orders[-1][1], None) if told_orders else (None, unigrams)))
        folders.append(shared.new_path(spark, "katz-lower"))

        def ask_first(row, step=step):
            return [(_STATE, row[1], row[1] % buckets, row[3]), *step.ask(row[1], Batch(load(row[3])), None)]

        def ask(number, rows, step=step, last=told_orders[-1:], folder=folders[-1]):
            below, turing, whole = last[0]
            b, p = begun(rows[0], below.k - 1)
            kept = b.grams(below.k)[1][b.backing(below.k)]
            at = np.concatenate([kept, step.needs(b)])
            p[at] = below.learn(b, rows[1:], p[at], turing, whole, at)
            values, codes = np.unique(p[kept], return_inverse=True)
            state = (_STATE, number, number % buckets, rows[0][3], save(folder, {"p": values, "codes": codes.astype(np.uint32)}))
            return [state, *step.ask(number, b, p)]

        def tell(bucket, rows, step=step):
            asked = [r for r in rows if r[0] != _STATE]
            return [r for r in rows if r[0] == _STATE] + (step.tell(bucket, asked) if asked else [])

        asked = learnt.mapInArrow(each_row(ask_first), _ROWS) if replies is None else by(learnt.unionByName(replies), "batch").mapInArrow(each_group(1, ask), _ROWS)
        counted = shared.written(by(asked, "bucket").mapInArrow(each_group(2, tell), _ROWS), "katz-grams", partition_by="kind")
        counted_at, counted = counted._loomgraph_path, counted.select(*states.columns)
        del asked
        if replies is not None:  # what the batches made of them is in their files
            shared.removed(spark, replies_at)
            if k > 3:
                shared.removed(spark, folders[-2])
        if tables is not None:
            tables[k] = counted.filter(f"kind = {_GRAM}")
        histogram = sum(np.frombuffer(r["b0"], np.int64) for r in counted.filter(f"kind = {_STAT}").select("b0").collect()) + np.zeros(K + 1, np.int64)
        turing = GoodTuring(histogram.tolist())
        sums: dict[tuple, tuple[np.ndarray, float]] = {}
        for r in counted.filter(f"kind = {_SPLIT}").select("b0", "b1", "b2").collect():  # a few for each bucket
            name = tuple(int(x) for x in np.frombuffer(r["b0"], np.uint64))
            c, f = sums.get(name, (np.zeros(K + 1, np.int64), 0.0))
            sums[name] = (c + np.frombuffer(r["b1"], np.int64), f + float(np.frombuffer(r["b2"])[0]))
        hot = Hot([(name, 1) for name in sums])
        values = [sums[tuple(int(x) for x in row)] for row in hot.ids] if sums else []
        whole = (hot, np.array([v[0] for v in values], np.int64).reshape(-1, K + 1), np.array([v[1] for v in values], np.float64))
        told_orders.append((step, turing, whole))
        replies, replies_at = counted.filter(f"kind = {_GRAMS}"), f"{counted_at}/kind={_GRAMS}"
        learnt = counted.filter(f"kind = {_STATE}")
        hot_rows = counted.filter(f"kind = {_HOT}")
        shared.release(spark)

    def score(batches, last=told_orders[-1]):
        top, turing, whole = last
        for _, rows in _grouped(batches, 1):
            b, p = begun(rows[0], top.k - 1)
            yield result(b, top.learn(b, rows[1:], p, turing, whole))

    return by(learnt.unionByName(replies), "batch").mapInArrow(score, scored)
