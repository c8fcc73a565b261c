"""Column-wise construction of a collection's Burrows-Wheeler transform with common prefixes.

The strings stand right-aligned.  Round 0 lists the empty suffixes; each further round inserts one
symbol of every string that has one left: the suffix that it begins.  Its place follows from the
transform so far (symbols smaller than it, and equal ones before its predecessor), and its common
prefixes with its neighbours follow from the smallest common prefix between the predecessors of
both.  The transform, the common prefixes and the owners are sequential files: every round reads
each once from front to end and writes it anew with the new rows merged in.  A collection is kept
so small (see ``suffixdedup``) that these files are arrays in the task's memory.
"""

from __future__ import annotations

import numpy as np


def _range_minimum(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k holds the minima of 2^k neighbours."""
    levels = [values]
    step = 1
    while 2 * step <= len(values):
        last = levels[-1]
        levels.append(np.minimum(last[:-step], last[step:]))
        step *= 2
    return levels


def _minimum(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of the ranges lo .. hi, both inclusive and not empty."""
    size = hi - lo + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), levels[0].dtype)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << k) + 1])
    return out


def build(data: np.ndarray, offsets: np.ndarray, most: int = 255) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of the strings data[offsets[i]:offsets[i+1]].

    Returns bwt (symbol + 1, or 0 before a string's start; uint16), lcp (with the row before, at most
    *most*; uint8), string and suffix length of every row.  Suffixes that are equal are in order of
    their strings; an end counts as no symbol, so common prefixes never go over it.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = data.astype(np.uint16) + np.uint16(1)
    string = np.arange(n, dtype=np.int32)
    bwt = np.zeros(n, np.uint16)
    full = size > 0
    bwt[full] = text[offsets[1:][full] - 1]
    lcp = np.zeros(n, np.uint8)
    length = np.zeros(n, np.int32)
    place = np.arange(n, dtype=np.int64)  # row of each string's last inserted suffix
    active = np.flatnonzero(full)
    done = 0
    while len(active):
        done += 1
        # rows by symbol, in order: where each row's own suffix goes
        order = np.argsort(bwt, kind="stable")
        none = int(np.searchsorted(bwt[order], 1))  # rows before a string's start go nowhere
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        active = active[np.argsort(place[active])]
        old = place[active]
        new = n + rank[old] - none
        # common prefixes with the rows before and after, by the predecessors' ranges
        levels = _range_minimum(lcp)
        at = rank[old]
        symbol = bwt[old]

        def common(left_rank: np.ndarray, right_rank: np.ndarray, valid: np.ndarray) -> np.ndarray:
            left, right = order[left_rank[valid]], order[right_rank[valid]]
            out = np.zeros(len(valid), np.int64)
            same = bwt[left] == bwt[right]
            inner = np.zeros(len(left), np.int64)
            inner[same] = 1 + _minimum(levels, left[same] + 1, right[same]).astype(np.int64)
            out[valid] = np.minimum(inner, most)
            return out

        before = common(np.maximum(at - 1, 0), at, at > none)
        has_next = at + 1 < len(bwt)
        after = common(at, np.minimum(at + 1, len(bwt) - 1), has_next)
        # merge the new rows in
        total = len(bwt) + len(active)
        fresh = np.zeros(total, bool)
        fresh[new] = True
        left = size[active] - done
        merged = np.empty(total, np.uint16)
        merged[~fresh] = bwt
        more = left > 0
        symbols = np.zeros(len(active), np.uint16)
        symbols[more] = text[offsets[active[more]] + left[more] - 1]
        merged[new] = symbols
        prefix = np.empty(total, np.uint8)
        prefix[~fresh] = lcp
        prefix[new] = before
        follow = new + 1
        ok = has_next & (follow < total)
        prefix[follow[ok]] = after[ok]
        owner = np.empty(total, np.int32)
        owner[~fresh] = string
        owner[new] = active
        deep = np.empty(total, np.int32)
        deep[~fresh] = length
        deep[new] = done
        # strings that are finished keep their rows where they are; only places of the active ones are needed
        place[active] = new
        bwt, lcp, string, length = merged, prefix, owner, deep
        active = active[more]
    return bwt, lcp, string, length
