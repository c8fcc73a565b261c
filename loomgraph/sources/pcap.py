"""Capture files in and out.

Reading deals files of any length over tasks by ranges of SPLIT bytes.  A capture file has no marks between its packets, so the
ranges of a long file are first walked from heads: the first range from the file's first packet, each other one from the first place where
CHAIN plausible packet headers follow each other.  A range's walk must end where the next one's began; one that
began elsewhere is walked again from where its predecessor ended, until all agree.  By induction from the first range all
starts are then exact, whatever the guesses were.  Files of one range are read in one go.  Tasks hold a block of a file, not a range.

A file ends before a packet that is cut off, or whose header tells more bytes than the packet had or the file's limit allows.
An empty file has no packets; one that doesn't begin as a capture file is an error.

Writing makes files of about FILE bytes from each partition's packets, as rows with the file's bytes for any sink that takes
binaries (``write``), or as files of a folder (``save``).
"""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.sources.store import scratch

#: Fixed values of the public capture file format: magic numbers of micro- and nanosecond files.
MICRO, NANO = 0xA1B2C3D4, 0xA1B23C4D
#: Bytes of packets after which another file begins.
FILE = 64 << 20
#: Bytes of a file that one task reads, bytes read at once, bytes looked through for a first packet and headers in a row that tell one.
SPLIT, BLOCK, LOOK, CHAIN = 128 << 20, 4 << 20, 1 << 20, 8
#: Packets and bytes of an Arrow batch.
ROWS, BYTES = 10_000, 8 << 20
#: Tasks of a pass at most; a task takes several ranges then.
TASKS = 20_000
SCHEMA = "path string, timestamp long, index long, data binary, link_type int"
FOUND = "path string, size long, begin long, start long, stop long, packets long"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """Spark tells paths without escapes, and those of local files with one slash."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(quote(uri, safe=":/@"))


class Capture:
    """An opened capture file and what its header tells."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        head = file.read_at(min(24, self.size), 0)
        order = next((o for o in "<>" if len(head) == 24 and struct.unpack_from(o + "I", head)[0] in (MICRO, NANO)), None)
        if order is None:
            raise ValueError("not a capture file")
        magic, _, _, _, _, self.limit, self.link = struct.unpack(order + "IHHiIII", head)
        self.order, self.unit = order, 1_000 if magic == MICRO else 1_000_000
        self.head = struct.Struct(order + "IIII").unpack_from
        self.at = 24

    def walk(self, start: int, stop: int, data: bool = True) -> Iterator[tuple[int, bytes | None]]:
        """Timestamp (ms) and bytes of the packets that begin in start..stop; ``at`` is then where the next one begins, or the file's size."""
        low, block = start, b""
        self.at = start
        while self.at < stop:
            if self.at + 16 > low + len(block):
                low, block = self.at, self.file.read_at(min(BLOCK, self.size - self.at), self.at)
                if len(block) < 16:
                    break
            seconds, part, length, whole = self.head(block, self.at - low)
            end = self.at + 16 + length
            if end > self.size or length > whole or self.limit and length > self.limit:
                break
            if data and end > low + len(block):
                low, block = self.at, self.file.read_at(min(max(BLOCK, 16 + length), self.size - self.at), self.at)
            begin, self.at = self.at + 16 - low, end
            yield seconds * 1000 + part // self.unit, block[begin : begin + length] if data else None
        else:
            return
        self.at = self.size

    def guess(self, begin: int, stop: int) -> int | None:
        """The first place in begin..stop that looks like a packet's head and whose followers do; None if there is none."""
        block = self.file.read_at(min(LOOK, self.size - begin), begin)
        n = len(block) - 15
        if n <= 0:
            return None
        raw = np.frombuffer(block, np.uint8).astype(np.uint32)
        shifts = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)
        part, length, whole = (sum(raw[k + i : k + i + n] << np.uint32(s) for i, s in enumerate(shifts)) for k in (4, 8, 12))
        likely = (part < self.unit * 1000) & (length > 0) & (length <= whole) & (length <= (self.limit or 1 << 18))
        for first in np.flatnonzero(likely[: max(0, stop - begin)]).tolist():
            at, seen = first, 0
            while at < n and likely[at] and seen < CHAIN:
                at, seen = at + 16 + int(length[at]), seen + 1
            if seen == CHAIN or begin + at == self.size or at >= n and seen > 1:
                return begin + first
        return None


def _opened(path: str) -> Capture:
    where, name = _place(path)
    return Capture(where.open_input_file(name))


def _listing(rows: DataFrame, split: int) -> DataFrame:
    """Rows (path, size, begin) of the ranges of files (path, length)."""
    whole = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))
    return rows.filter("length > 0").select("path", F.col("length").cast("long").alias("size"), F.explode(whole).alias("begin"))


def _walked(ranges: DataFrame, split: int) -> DataFrame:
    """Walks the headers of ranges (path, size, begin, start); a range without a start guesses one."""

    def run(batches):
        for batch in batches:
            out = []
            for path, size, begin, start in zip(*(c.to_pylist() for c in batch.columns)):
                if start is not None and start >= begin + split:  # a packet reaches over the whole range
                    out.append((path, size, begin, start, start, 0))
                    continue
                capture = _opened(path)
                with capture.file:
                    start = capture.guess(begin, begin + split) if start is None else start
                    n = sum(1 for _ in capture.walk(start, begin + split, data=False)) if start is not None else None
                out.append((path, size, begin, start, capture.at if n is not None else None, n))
            kinds = [pa.string()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["path", "size", "begin", "start", "stop", "packets"])

    return ranges.select("path", "size", "begin", "start").mapInArrow(run, FOUND)


def _stored(rows: DataFrame) -> DataFrame:
    path = scratch(rows.sparkSession, "capture-ranges")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(FOUND).parquet(path)


def _synchronised(ranges: DataFrame, split: int) -> DataFrame:
    """The exact starts and ends of all ranges of files that have several."""
    first = F.when(F.col("begin") == 0, F.lit(24).cast("long"))
    found = _stored(_walked(ranges.withColumn("start", first), split))
    # ends only grow, so the largest one before a range is its predecessor's, and a packet over many ranges takes one round
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        due = found.withColumn("due", F.max("stop").over(before)).withColumn("wrong", F.expr("coalesce(due >= begin and not (due <=> start), false)"))
        wrong = due.filter("wrong").select("path", "size", "begin", F.col("due").alias("start"))
        if not wrong.take(1):
            return found
        rest = due.filter("not wrong").drop("due", "wrong")
        found = _stored(rest.unionByName(_walked(_dealt(wrong), split)))


def _dealt(rows: DataFrame) -> DataFrame:
    """A task for each row.  At least two: of a single one Spark takes all packets to be where they belong, and sorts them in one task."""
    return rows.repartition(max(2, min(TASKS, rows.count())))


def packets(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The packets of files (path, length): path, timestamp (ms), index in the file, data, link_type.  Walks the headers of longer files at once."""
    ranges = _listing(files.select("path", "length"), split)
    one = ranges.filter(F.col("size") <= split).select("path", F.lit(24).cast("long").alias("start"), F.col("size").alias("end"), F.lit(0).cast("long").alias("before"))
    long = ranges.filter(F.col("size") > split)
    if long.take(1):
        before = F.coalesce(F.sum("packets").over(Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = _synchronised(_dealt(long), split).withColumn("before", before).filter("packets > 0")
        one = one.unionByName(found.select("path", "start", (F.col("begin") + split).alias("end"), "before"))

    def run(batches):
        for batch in batches:
            for path, start, end, before in zip(*(c.to_pylist() for c in batch.columns)):
                capture = _opened(path)
                with capture.file:
                    found, index = capture.walk(start, end), before
                    while part := _slice(found):
                        at, data = zip(*part)
                        n = len(part)
                        columns = [pa.array([path] * n), pa.array(at, pa.int64()), pa.array(range(index, index + n), pa.int64()), pa.array(data, pa.binary()), pa.array([capture.link] * n, pa.int32())]
                        index += n
                        yield pa.RecordBatch.from_arrays(columns, ["path", "timestamp", "index", "data", "link_type"])

    return _dealt(one).mapInArrow(run, SCHEMA)


def _slice(found: Iterator[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The next packets, until they have ROWS rows or BYTES bytes."""
    out, have = [], 0
    for one in itertools.islice(found, ROWS):
        out.append(one)
        have += len(one[1])
        if have >= BYTES:
            break
    return out


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The packets of the capture files of a path (see :func:`packets`); Spark lists the files and doesn't read them itself."""
    return packets(spark.read.format("binaryFile").load(path), split)


def follow(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, split: int = SPLIT, once: bool = True):
    """Hands the packets of new capture files to *sink* (rows, epoch) by micro-batches.  Files must come whole, by a move into the folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    writer = files.select("path", "length").writeStream.foreachBatch(lambda rows, epoch: sink(packets(rows, split), epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _head(link_type: int) -> bytes:
    return struct.pack("<IHHiIII", MICRO, 2, 4, 0, 0, 262_144, link_type)


def _packet(at: int, data: bytes) -> bytes:
    return struct.pack("<IIII", at // 1000, at % 1000 * 1000, len(data), len(data)) + data


def _rows(raw: DataFrame, link_type: int) -> DataFrame:
    return raw.filter(F.col("link_type") == link_type).select("timestamp", "data").sortWithinPartitions("timestamp", "data")


def write(raw: DataFrame, link_type: int = 1, size: int = FILE) -> DataFrame:
    """Rows (link_type, packets, content): capture files of each partition's packets of the link type, in order of time."""

    def file(parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"link_type": pa.array([link_type], pa.int32()), "packets": [len(parts)], "content": pa.array([_head(link_type) + b"".join(parts)], pa.binary())})

    def run(batches):
        parts, have = [], 0
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.append(_packet(at, data))
                have += len(parts[-1])
                if have >= size:
                    yield file(parts)
                    parts, have = [], 0
        if parts:
            yield file(parts)

    return _rows(raw, link_type).mapInArrow(run, "link_type int, packets long, content binary")


def save(raw: DataFrame, folder: str, link_type: int = 1, size: int = FILE) -> DataFrame:
    """Writes capture files into *folder*, from each partition's packets of the link type in order of time; rows (path, packets, length).

    Files are written under hidden names and moved to names by partition and number, so that a task's later attempt puts the same
    files in place of those of a lost one.
    """

    def run(batches):
        part, n, out, count, have = TaskContext.get().partitionId(), 0, None, 0, 0
        where, top = _place(folder)

        def moved() -> pa.RecordBatch:
            out.close()
            name = f"part-{part:06d}-{n:04d}.pcap"
            where.move(hidden, f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "packets": [count], "length": [have]})

        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    hidden = f"{top}/.{uuid.uuid4().hex}"
                    out, count, have = where.open_output_stream(hidden, buffer_size=BLOCK), 0, 24
                    out.write(_head(link_type))
                one = _packet(at, data)
                out.write(one)
                count, have = count + 1, have + len(one)
                if have >= size:
                    yield moved()
                    out, n = None, n + 1
        if out is not None:
            yield moved()

    where, top = _place(folder)
    where.create_dir(top, recursive=True)  # there is a folder to read even if there are no packets
    path = scratch(raw.sparkSession, "capture-files")
    _rows(raw, link_type).mapInArrow(run, "path string, packets long, length long").write.parquet(path)
    return raw.sparkSession.read.schema("path string, packets long, length long").parquet(path)
