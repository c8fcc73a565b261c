"""Operator 9: token ids in fixed-width bit-packed files.

Every id takes the fewest bits that hold the vocabulary.  Ids are packed in blocks of a fixed
number, each beginning at a byte, and a footer lists the blocks' offsets and the documents'
starts, so that any document or block is read and unpacked with numpy on its own.

File: ``IDPK`` magic, version, width, ids per block (4 x uint32); blocks; footer of uint64 arrays
(block offsets, n_blocks + 1; doc ids; null flags; doc starts, n_docs + 1); trailer of uint64
n_blocks, n_docs, footer offset; ``IDPK``.

Documents are sorted by id over all files by a range shuffle on the id; equal ids are dealt by the
text's hash and the input partition, so repeated rows don't meet in one task.  A task writes one
file, under a name of its own attempt, and returns one row about it; these rows are written as a
table before anything is read, so a task that runs again leaves at most an unused file.

Null or empty text is the end id alone.  A null id sorts first.  Repeated rows are each written.
An empty table gives no file and no row.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm import files, shared, tokens, words

MAGIC = b"IDPK"
HEAD = struct.Struct("<4sIII")
TAIL = struct.Struct("<QQQ4s")
#: Ids in a block; a multiple of 8, so that every block fills whole bytes.
BLOCK = 1 << 14
#: Bytes of text encoded at a time in a task.
TEXT = 8 << 20

MANIFEST = "part int, path string, n_ids long, n_docs long, bytes long"


def width_of(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as *width*-bit little-endian numbers, the last byte filled with zero bits."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first *n* ids of what :func:`pack` made."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count=n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Writes one file; memory holds a block's rest and the footer only."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.rest = np.empty(0, np.uint32)
        self.blocks, self.docs, self.nulls, self.starts = [HEAD.size], [], [], [0]
        out.write(HEAD.pack(MAGIC, 1, width, block))

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.nulls.append(nulls)
        base = self.starts[-1] if isinstance(self.starts[-1], int) else int(self.starts[-1][-1])
        self.starts.append(offsets[1:] + base)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // self.block * self.block
        for at in range(0, full, self.block):
            self._block(ids[at : at + self.block])
        self.rest = ids[full:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.out.write(data)
        self.blocks.append(self.blocks[-1] + len(data))

    def close(self) -> tuple[int, int, int]:
        if len(self.rest):
            self._block(self.rest)
        starts = np.concatenate([np.atleast_1d(np.asarray(x, np.uint64)) for x in self.starts])
        docs = np.concatenate(self.docs).astype(np.int64).view(np.uint64)
        footer = [np.array(self.blocks, np.uint64), docs, np.concatenate(self.nulls).astype(np.uint64), starts]
        for part in footer:
            self.out.write(part.astype("<u8").tobytes())
        self.out.write(TAIL.pack(len(self.blocks) - 1, len(docs), self.blocks[-1], MAGIC))
        self.out.close()
        size = self.blocks[-1] + sum(8 * len(x) for x in footer) + TAIL.size
        return int(starts[-1]), len(docs), size


class Reader:
    """Random access to one file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        magic, _, self.width, self.block = HEAD.unpack(file.read_at(HEAD.size, 0))
        n_blocks, n_docs, footer, end = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a packed id file")
        table = np.frombuffer(file.read_at(size - TAIL.size - footer, footer), "<u8")
        self.blocks, table = table[: n_blocks + 1].astype(np.int64), table[n_blocks + 1 :]
        self.doc_ids, self.nulls = table[:n_docs].view(np.int64), table[n_docs : 2 * n_docs].astype(bool)
        self.starts = table[2 * n_docs :].astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop of the file: only the blocks that hold them are read."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        n = min((last + 1) * self.block, int(self.starts[-1])) - first * self.block
        return unpack(data, self.width, n)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with *end_id* after each document."""
    n = len(offsets) - 1
    shifted = offsets + np.arange(n + 1)
    out = np.full(int(shifted[-1]), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[shifted[1:] - 1] = False
    out[keep] = ids
    return out, shifted


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and write all documents in ascending id order; the files' table (part, path, n_ids, n_docs, bytes, start)."""
    spark = docs.sparkSession
    shared.tune(spark)

    def save(batches):
        enc = tokens.encoder(tokenizer)
        writer = uri = None
        part = TaskContext.get().partitionId()
        for table in words.regroup(batches, "text", TEXT):
            if writer is None:
                uri, out = files.create(folder, f"ids-{part:06d}")
                writer = Writer(out, width_of(max(enc.vocab_size, end_id + 1)), block)
            data, offsets = words.column_bytes(table["text"])
            ids, starts = with_end(*enc.encode(data, offsets), end_id)
            key = table["doc_id"].combine_chunks()
            writer.add(key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False), ids, starts)
        if writer is not None:
            n_ids, n_docs, size = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [uri], "n_ids": [n_ids], "n_docs": [n_docs], "bytes": [size]})

    keyed = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.spark_partition_id()]
    dealt = keyed.withColumn("h", order[1]).withColumn("p", order[2]).repartitionByRange("doc_id", "h", "p").sortWithinPartitions("doc_id", "h", "p")
    manifest = shared.written(dealt.select("doc_id", "text").mapInArrow(save, MANIFEST), "ids-manifest")
    before = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row for each file
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Documents of the files of :func:`write`: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32)."""

    def load(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.opened(path) as file:
                    reader = Reader(file)
                    n = len(reader.doc_ids)
                    at = 0
                    while at < n:  # some documents at a time, one at least
                        to = max(at + 1, int(np.searchsorted(reader.starts, reader.starts[at] + (1 << 21), "right")) - 1)
                        lo = int(reader.starts[at])
                        raw = reader.ids(lo, int(reader.starts[to])).astype("<u4").tobytes()
                        cut = (reader.starts[at : to + 1] - lo) * 4
                        crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(reader.doc_ids[at:to], pa.int64(), mask=reader.nulls[at:to]),
                            "start": pa.array(reader.starts[at:to] + start, pa.int64()),
                            "n_tokens": pa.array(np.diff(reader.starts[at : to + 1]), pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        })
                        at = to

    spread = manifest.select("path", "start").repartition(shared.partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")
