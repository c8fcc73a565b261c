"""Token ids of whole texts with a public byte-level BPE tokenizer, one BPE call per distinct word.

A byte-level BPE text splits at its pre-tokenizer's pattern, and no merge crosses a split.  A
single space or newline between two visible characters is always such a split, so a text's ids
are its words' ids one after another.  Words are found and hashed with numpy; only words that
the worker has not met are sent to the library.  Texts with any other white space or with a
special token's string are split by the pattern itself or encoded by the library directly.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

from loomgraph.llm import words

#: Words, and pre-tokens, remembered by a worker process; beyond it starts anew.
CACHE = 1_500_000
_CUTS = bytes([0x20, 0x0A])
#: Bytes of white space other than space and newline, or that may begin such a character in UTF-8.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x09, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD[0x0A] = False
_CUT = np.zeros(256, bool)
_CUT[list(_CUTS)] = True
_MARKS = b".,!?;:"
_MARK = np.zeros(256, bool)
_MARK[list(_MARKS)] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True
_KINDS = words.mix(np.array([11, 12, 13], np.uint64))


class Encoder:
    """Ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (
            not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not spec.get("truncation") and spec["model"].get("type") == "BPE"
            and all(x.get("special") and not x.get("lstrip") and not x.get("rstrip") and not x.get("single_word") for x in spec["added_tokens"])
        )
        self.special = [] if special_as_text else [x["content"] for x in spec["added_tokens"]]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.vocab_size = self.tokenizer.get_vocab_size()
        self._reset()

    def _reset(self) -> None:
        self.known: dict[int, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.pool = array("I")
        self.at = array("q", [0])

    def _bpe(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def _piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > CACHE // 6:
                self.pieces.clear()
            ids = self.pieces[piece] = self._bpe(piece)
        return ids

    def _split(self, text: str, space: bool = False) -> list[int]:
        if text.isalpha():  # one pre-token
            if text.isascii():
                return [t.id for t in self.tokenizer.model.tokenize(self.letters[0x20] + text if space else text)]
            return self._bpe(" " + text if space else text)
        out: list[int] = []
        for piece in self.pattern.findall(" " + text if space else text):
            out += self._piece(piece)
        return out

    def whole(self, text: str) -> list[int]:
        """Ids of one text, without the word cache."""
        if not self.by_word or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self._split(text)

    def _add(self, key: int, ids: list[int]) -> int:
        self.known[key] = slot = len(self.at) - 1
        self.pool.extend(ids)
        self.at.append(len(self.pool))
        return slot

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and each text's start (n+1 offsets)."""
        n = len(offsets) - 1
        slow = self._slow(data, offsets)
        if len(self.known) > CACHE:
            self._reset()
        marks = self._marks(data, offsets)
        starts, ends, hashes, first = words.split_words(data, offsets, _CUTS, fold=False, marks=marks)
        doc = np.repeat(np.arange(n), np.diff(first))
        keep = ~slow[doc]
        starts, ends, hashes, doc = starts[keep], ends[keep], hashes[keep], doc[keep]
        kind = np.zeros(len(starts), np.int64)  # what stands before: nothing, a space, a newline
        inner = starts > offsets[doc]
        kind[inner] = np.where(data[starts[inner] - 1] == 0x20, 1, 2)
        uniq, sample, inverse = np.unique(hashes ^ _KINDS[kind], return_index=True, return_inverse=True)
        known, newline = self.known, self._piece("\n")
        slots = list(map(known.get, uniq.tolist()))
        for i in [i for i, slot in enumerate(slots) if slot is None]:
            w = sample[i]
            text, k = data[starts[w] : ends[w]].tobytes().decode(), kind[w]
            slots[i] = self._add(int(uniq[i]), newline + self._split(text) if k == 2 else self._split(text, k == 1))
        last = np.minimum(ends, len(data) - 1)
        has = (ends < offsets[doc + 1]) & marks[last]
        byte = data[last[has]]
        table = np.zeros(256, np.int64)
        for b in np.unique(byte).tolist():
            table[b] = known[~b] if ~b in known else self._add(~b, self._bpe(chr(b)))
        places = np.array(self.at, np.int64)
        sizes, pool = np.diff(places), np.array(self.pool, np.uint32)
        slots = np.array(slots, np.int64)
        at = np.zeros(2 * len(inverse), np.int64)  # each word, and the mark after it if there is one
        size = np.zeros(2 * len(inverse), np.int64)
        at[0::2], size[0::2] = places[slots][inverse], sizes[slots][inverse]
        at[1::2][has], size[1::2][has] = places[table[byte]], sizes[table[byte]]
        doc = np.repeat(doc, 2)
        if not slow.any():
            ids = pool[words.ragged(at, size)]
            count = np.zeros(n, np.int64)
            np.add.at(count, doc, size)
            return ids, np.concatenate([[0], np.cumsum(count)])
        parts, count = [], np.zeros(n, np.int64)
        lo, hi = np.searchsorted(doc, np.arange(n), "left"), np.searchsorted(doc, np.arange(n), "right")
        for i in range(n):
            if slow[i]:
                ids = np.array(self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()), np.uint32)
            else:
                ids = pool[words.ragged(at[lo[i] : hi[i]], size[lo[i] : hi[i]])]
            parts.append(ids)
            count[i] = len(ids)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), np.concatenate([[0], np.cumsum(count)])

    @staticmethod
    def _marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Punctuation that ends a word and stands right after a letter or digit: a pre-token of its own."""
        n = len(data)
        out = _MARK[data]
        where = np.flatnonzero(out)
        follows = np.ones(len(where), bool)
        inner = where < n - 1
        follows[inner] = _CUT[data[where[inner] + 1]]
        stops = offsets[np.minimum(np.searchsorted(offsets, where, side="right"), len(offsets) - 1)]
        begins = offsets[np.searchsorted(offsets, where, side="right") - 1]
        follows |= where + 1 == stops
        before = data[where - 1]
        accented = (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (data[where - 2] == 0xC3) & (where - 1 > begins)
        good = follows & (where > begins) & (_ALNUM[before] | accented)
        out[where[~good]] = False
        return out

    def _slow(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that can't be cut at every space and newline."""
        n = len(offsets) - 1
        slow = np.zeros(n, bool)
        if not self.by_word:
            slow[:] = True
            return slow
        if not len(data):
            return slow
        cut = _CUT[data]
        bad = _ODD[data]
        bad[1:] |= cut[1:] & cut[:-1]
        full = offsets[1:] > offsets[:-1]
        bad[offsets[:-1][full]] |= cut[offsets[:-1][full]]
        bad[offsets[1:][full] - 1] |= cut[offsets[1:][full] - 1]
        where = np.flatnonzero(bad)
        # a character of two or three bytes is odd only if it is white space or lies outside a plain word: checked by text
        slow[np.unique(np.searchsorted(offsets, where, side="right") - 1)] = True
        if self.special:
            for m in re.finditer(b"|".join(re.escape(s.encode()) for s in self.special), data.tobytes()):
                slow[np.searchsorted(offsets, m.start(), side="right") - 1] = True
        return slow


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker process's encoder; kept from task to task."""
    return Encoder(path, special_as_text)
