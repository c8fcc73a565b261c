"""Operator 4: documents into as few fixed-size sequences as possible.

A document's ids and an end id are cut into pieces of at most one sequence: only longer documents
are cut, and the first piece takes what doesn't fill a sequence.  Pieces are dealt at random into
groups of about GROUP pieces.  Inside a group they are placed best-fit in decreasing order; then a
local search works on the underfull bins: it takes the emptiest bin and moves its pieces into other
bins, exchanges a piece, or two, for a smaller one of another bin, whenever that increases the sum
of squared fills, until bins become empty and no such move exists any more.  Every move raises a whole
number that is at most bins * capacity**2, so the search ends; it has no other bound.

A group loses about one bin, so the count of sequences stays within 1 / (bins of a group) of what
one group over all pieces would give, whatever the input's size; no group grows with the input.

Null or empty text is the end id alone.  Repeated rows are each packed.  An empty table gives no
row.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import bitpack, shared, tokens, words

#: Pieces packed together in one task.
GROUP = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of these lengths: document, number, start and length of each piece."""
    count = np.maximum(1, -(-lengths // capacity))
    doc = np.repeat(np.arange(len(lengths)), count)
    piece = words.ragged(np.zeros(len(lengths), np.int64), count)
    first = lengths - (count - 1) * capacity
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first[doc], capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start (ids of the document before it), length, ids_crc32."""
    shared.tune(docs.sparkSession)

    def encode(batches):
        enc = tokens.encoder(tokenizer)
        for table in words.regroup(batches, "text", bitpack.TEXT):
            ids, offsets = bitpack.with_end(*enc.encode(*words.column_bytes(table["text"])), end_id)
            doc, piece, start, length = cut(np.diff(offsets), capacity)
            at = (offsets[doc] + start) * 4
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": table["doc_id"].combine_chunks().take(pa.array(doc)), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            })

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).mapInArrow(encode, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the bin with the least room that still takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        size = lengths[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


class Search:
    """Local search over underfull bins, to a local optimum.

    A move brings one or two pieces of a bin, the donor, to another bin, for nothing or for a smaller piece in
    exchange, where that raises the sum of squared fills.  Donors are taken from a queue, the emptiest first; a bin
    that a move changes is queued again, and the search ends when a pass over all underfull bins finds no move.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.room = [capacity - sum(lengths[i] for i in b) for b in bins]
        self.by_room: dict[int, set[int]] = defaultdict(set)
        self.by_reach: dict[int, dict[int, set[int]]] = defaultdict(dict)  # length + room of its bin -> length -> bins
        self.rooms = self.reaches = 0
        for b in range(len(bins)):
            self._show(b)

    def _show(self, b: int) -> None:
        room = self.room[b]
        if room <= 0 or not self.bins[b]:
            return
        self.by_room[room].add(b)
        self.rooms |= 1 << room
        for length in {self.lengths[i] for i in self.bins[b]}:
            self.by_reach[length + room].setdefault(length, set()).add(b)
            self.reaches |= 1 << (length + room)

    def _hide(self, b: int) -> None:
        room = self.room[b]
        if room <= 0 or not self.bins[b]:
            return
        self.by_room[room].discard(b)
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        for length in {self.lengths[i] for i in self.bins[b]}:
            reach = self.by_reach[length + room]
            reach[length].discard(b)
            if not reach[length]:
                del reach[length]
            if not reach:
                self.reaches &= ~(1 << (length + room))

    def _find(self, donor: int, size: int, single: bool) -> tuple[int, int, int | None] | None:
        """The move of *size* ids that fills another bin best: what stays free, the bin, and the length that comes back."""
        fill = self.capacity - self.room[donor]
        best = None
        if single and (fit := self.rooms >> size):
            room = size + (fit & -fit).bit_length() - 1
            if self.capacity - room + size > fill:  # the sum of squares grows
                best = (room - size, min(self.by_room[room]), None)
        reach = size
        while (fit := self.reaches >> reach) and (best is None or reach - size < best[0]):
            reach += (fit & -fit).bit_length() - 1
            if best is not None and reach - size >= best[0]:
                break
            # with this reach the bin ends as full whatever comes back; that is more than the donor's fill now, or no move does it
            if self.capacity - (reach - size) > fill:
                length = max((x for x in self.by_reach[reach] if x < size), default=None)
                if length is not None:
                    return reach - size, min(self.by_reach[reach][length]), length
            reach += 1
        return best

    def _move(self, donor: int, give: list[int], b: int, length: int | None) -> None:
        back = None
        self._hide(b)
        if length is not None:
            back = next(i for i in self.bins[b] if self.lengths[i] == length)
            self.bins[b].remove(back)
        for i in give:
            self.bins[donor].remove(i)
            self.bins[b].append(i)
        if back is not None:
            self.bins[donor].append(back)
        for x in (donor, b):
            self.room[x] = self.capacity - sum(self.lengths[i] for i in self.bins[x])
        self._show(b)

    def _improve(self, donor: int) -> int | None:
        """One move of the donor, which is hidden; the bin that it changed."""
        by_length: dict[int, list[int]] = {}
        for i in self.bins[donor]:
            by_length.setdefault(self.lengths[i], []).append(i)
        own = sorted(by_length, reverse=True)
        for x in own:
            if move := self._find(donor, x, True):
                self._move(donor, [by_length[x][0]], *move[1:])
                return move[1]
        top = self.reaches.bit_length()  # no piece with its bin's room reaches further
        for n, x in enumerate(own):
            for y in own[n:]:
                if x + y >= top or x == y and len(by_length[x]) < 2:
                    continue
                if move := self._find(donor, x + y, False):
                    self._move(donor, [by_length[x][0], by_length[y][-1]], *move[1:])
                    return move[1]
        return None

    def run(self) -> int:
        """Search until no donor has a move; the number of moves."""
        moves, changed = 0, True
        while changed:
            changed = False
            queue = [(-self.room[b], b) for b in range(len(self.bins)) if self.room[b] > 0 and self.bins[b]]
            heapq.heapify(queue)
            while queue:
                room, donor = heapq.heappop(queue)
                if -room != self.room[donor] or not self.bins[donor]:
                    continue  # changed since; it is queued with its new room
                self._hide(donor)
                found = self._improve(donor)
                self._show(donor)
                if found is not None:
                    changed, moves = True, moves + 1
                    for b in (donor, found):
                        if self.room[b] > 0 and self.bins[b]:
                            heapq.heappush(queue, (-self.room[b], b))
        return moves


def pack(items: DataFrame, capacity: int = 2048, length: str = "length", group: int = GROUP) -> DataFrame:
    """Rows of *items* with sequence_id and offset; a row longer than *capacity* or not longer than 0 is an error.

    *items* should be a stored table: it is counted, then dealt out.
    """
    names = items.columns
    groups = max(1, -(-items.count() // group))
    schema = T.StructType(items.schema.fields[:]).add("sequence_id", "long").add("offset", "long")

    def place(batches):
        held = [b for b in batches if b.num_rows]  # about *group* narrow rows
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = table[length].to_pylist()
        if min(lengths) <= 0 or max(lengths) > capacity:
            raise ValueError(f"{length} must lie in 1..{capacity}")
        search = Search(lengths, best_fit(lengths, capacity), capacity)
        search.run()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = TaskContext.get().partitionId() << 40
        for n, b in enumerate(b for b in search.bins if b):
            at = 0
            for i in b:
                sequence[i], offset[i] = base + n, at
                at += lengths[i]
        out = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches()

    return items.repartition(groups).mapInArrow(place, schema).select(*names, "sequence_id", "offset")
