"""Vectorised word kernel shared by the text operators.

Text is handled as the UTF-8 bytes of an Arrow string column.  Words are
found with byte tables and named by a 64-bit polynomial hash, so that no
Python object is made per word.  A hash is seeded, mixed with the word's
length, and only ever compared inside one job; at n distinct words in one
comparison the chance of any collision is below n**2 / 2**63.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Word separators of the text contracts: space and U+0009 to U+000D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes handled at a time; a longer document is cut at separators.
SLICE = 1 << 17

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.empty(n + 1, np.uint64)
    down = np.empty(n + 1, np.uint64)
    inverse = np.uint64(pow(int(_R), -1, 1 << 64))
    for out, base in ((up, _R), (down, inverse)):
        out[0] = 1
        done = 1
        step = base
        while done <= n:  # doubling: out[done:2*done] = out[:done] * base**done
            m = min(done, n + 1 - done)
            out[done : done + m] = out[:m] * step
            done += m
            step = np.uint64(int(step) ** 2 % (1 << 64))
    return up, down


@functools.lru_cache(maxsize=8)
def _tables(spaces: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    word = np.ones(256, bool)
    word[list(spaces)] = False
    value = np.arange(256, dtype=np.uint64)
    if fold:
        value[ord("A") : ord("Z") + 1] += np.uint64(32)
    value += np.uint64(1)
    return word, value


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and each text's start (n+1 offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if big else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _slices(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    at, end = 0, len(data)
    while at < end:
        to = min(at + size, end)
        if to < end:
            cut = int(np.searchsorted(offsets, to, side="right")) - 1
            if offsets[cut] > at:
                to = int(offsets[cut])
            else:  # inside one document: up to its last separator, or the next one after the slice
                gaps = np.flatnonzero(~word[data[at:to]])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:
                    stop = int(offsets[np.searchsorted(offsets, at, side="right")])
                    while to < stop and word[data[to]]:
                        to += 1
        yield at, to
        at = to


def split_words(
    data: np.ndarray, offsets: np.ndarray, spaces: bytes = SPACES, fold: bool = True, size: int = SLICE, marks: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text: start, end (byte positions), hash, and word_offsets (first word of each text, n+1).

    marks: positions that end a word without being part of it.
    """
    word, value = _tables(spaces, fold)
    all_starts, all_ends, all_hashes = [], [], []
    inner = np.asarray(offsets[1:-1])
    for lo, hi in _slices(data, offsets, word, size):
        part = data[lo:hi]
        is_word = word[part]
        if marks is not None:
            is_word &= ~marks[lo:hi]
        edge = inner[np.searchsorted(inner, lo, "right") : np.searchsorted(inner, hi, "left")] - lo
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = is_word[:-1]
        before[edge] = False
        starts = np.flatnonzero(is_word & ~before)
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = is_word[1:]
        after[edge - 1] = False
        ends = np.flatnonzero(is_word & ~after) + 1
        up, down = _powers(1 << max(1, int(len(part)).bit_length()))
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(value[part] * up[: len(part)], out=total[1:])
        hashes = (total[ends] - total[starts]) * down[starts]
        hashes = mix(hashes + (ends - starts).astype(np.uint64) * _M2)
        all_starts.append(starts + lo)
        all_ends.append(ends + lo)
        all_hashes.append(hashes)
    starts = np.concatenate(all_starts) if all_starts else np.empty(0, np.int64)
    ends = np.concatenate(all_ends) if all_ends else np.empty(0, np.int64)
    hashes = np.concatenate(all_hashes) if all_hashes else np.empty(0, np.uint64)
    return starts, ends, hashes, np.searchsorted(starts, offsets, side="left")


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.LargeListArray:
    """An Arrow list column over flat values."""
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start .. start+length of every row, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def regroup(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    """Join or cut Arrow batches so that each table has about *size* bytes of *column* (one row at least)."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            _, offsets = column_offsets(batch.column(batch.schema.get_field_index(column)))
            room = offsets[at] + max(0, size - have)
            to = int(np.searchsorted(offsets, room, side="right")) - 1
            to = min(max(to, at + (not held)), batch.num_rows)
            if to > at:
                held.append(batch.slice(at, to - at))
                have += int(offsets[to] - offsets[at])
            if to < batch.num_rows or have >= size:
                yield pa.Table.from_batches(held)
                held, have = [], 0
            at = to
    if held:
        yield pa.Table.from_batches(held)


def column_offsets(column: pa.Array) -> tuple[int, np.ndarray]:
    """Byte offsets of a string column's rows, nulls counting 0 or whatever lies under them."""
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return 0, np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if big else np.int32, count=len(column) + 1 + column.offset)
    return int(offsets[-1]), offsets[column.offset :].astype(np.int64)
