"""Operator 8: WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME bytes; a bundle ends with a
seek table in a skippable frame (the public seekable format: 0x184D2A5E, an entry of compressed and
decompressed size for each frame, the number of frames, a descriptor byte, 0x8F92EAB1).  The index
table maps every record to its bundle, frame offset, place in the frame and length, so one record
costs one read of the seek table's frame.

Of records with equal payloads of at least *min_bytes* bytes the one with the smallest page_id is
written as response and the others as revisit records without the payload.  Payloads are compared
by SHA-1 and length; only digests that occur more than once are joined back, so the payloads
themselves are not shuffled when these are few.  Each task writes its own bundle; the index is
stored as a table before anything is read, which commits the bundles named in it.

Null html is an empty payload.  A null page_id is kept as null and is a response only if no record
of the group has an id.  Rows that repeat a page_id with the same payload are all written alike
(all response if that id is the smallest).  A record's id names the page and, by a name-based UUID, its address and payload, so
pages that share a page_id, or have none, have ids of their own; rows that are equal in all three are the same record and share
one.  A revisit refers to the response with the smallest page_id and, of these, address.  An empty table gives no bundle.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import files, shared

#: Decompressed bytes of records in a frame; a larger record has a frame of its own.
FRAME = 1 << 20
#: Decompressed bytes after which a task begins another bundle.
BUNDLE = 1 << 30
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, record_id string, path string, frame long, frame_offset long, record_offset long, record_length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page_id: int | None, url: str | None, sha1: bytes) -> str:
    """A record's id."""
    return f"<urn:page:{'' if page_id is None else page_id}:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page_id, url, sha1.hex()]))}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: str | None) -> tuple[str, bytes]:
    """One WARC record and its id; one that refers to another is a revisit, and keeps the payload's length in its HTTP header."""
    name, revisit = name_of(page_id, url, sha1), refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Writes one bundle."""

    def __init__(self, out, frame: int = FRAME, level: int = 3):
        self.out, self.frame = out, frame
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int]] = []
        self.at, self.total = 0, 0
        self.held, self.size = [], 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame number, frame offset and place in the frame."""
        if self.held and self.size + len(data) > self.frame:
            self.flush()
        place = (len(self.entries), self.at, self.size)
        self.held.append(data)
        self.size += len(data)
        self.total += len(data)
        return place

    def flush(self) -> None:
        packed = self.zstd.compress(b"".join(self.held))
        self.out.write(packed)
        self.entries.append((len(packed), self.size))
        self.at += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        table = b"".join(struct.pack("<II", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of every frame."""
    size = file.size()
    n, descriptor, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    raw = file.read_at(n * width, size - 9 - n * width)
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", raw, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def frame_bytes(file, offset: int, packed: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(file.read_at(packed, offset))


def fetch(path: str, frame: int, record_offset: int, record_length: int) -> bytes:
    """One record by its index row: reads the seek table and one frame."""
    with files.opened(path) as file:
        offset, packed, _ = seek_table(file)[frame]
        return frame_bytes(file, offset, packed)[record_offset : record_offset + record_length]


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records in *data*."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin = end + 4
        stop = begin + int(headers["Content-Length"])
        yield headers, data[begin:stop]
        at = stop + 4


def write(pages: DataFrame, folder: str, min_bytes: int = 0, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Write every page's record; the index table, one row for each record."""
    spark = pages.sparkSession
    shared.tune(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    groups = rows.filter(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = shared.written(groups.filter("n > 1").drop("n"), "warc-groups")
    role = rows.join(groups, ["sha1", "size"], "left").select("page_id", "url", "payload", "sha1", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))

    def save(batches):
        part, out, uri, n = TaskContext.get().partitionId(), None, "", 0
        for batch in batches:
            index = []
            for page_id, url, payload, sha1, first, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or out.total >= bundle:
                    if out is not None:
                        out.close()
                    uri, stream = files.create(folder, f"pages-{part:06d}-{n:03d}")
                    out, n = Bundle(stream, frame), n + 1
                revisit = first is not None and page_id != first
                name, data = record(page_id, url, payload, sha1, name_of(first, first_url, sha1) if revisit else None)
                index.append((page_id, name, uri, *out.add(data), len(data)))
            columns = list(zip(*index)) if index else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["page_id", "record_id", "path", "frame", "frame_offset", "record_offset", "record_length"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
        if out is not None:
            out.close()

    return shared.written(role.mapInArrow(save, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Read every frame of the index's bundles: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A row of work is a frame; frames are dealt over shuffle-partitions tasks, and a task reads each bundle's
    seek table once, whatever the number of bundles.
    """

    def number(name: str | None) -> int | None:
        digits = name[len("<urn:page:") :].partition(":")[0] if name else ""
        return int(digits) if digits else None

    def rows_of(data: bytes, path: str) -> pa.RecordBatch:
        out = []
        for headers, block in parse(data):
            head, _, payload = block.partition(b"\r\n\r\n")
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if headers["WARC-Type"] == "response":
                size = len(payload)
                if digest_of(payload) != digest:
                    raise ValueError(f"damaged payload of {headers['WARC-Record-ID']} in {path}")
            else:
                size = int(head.decode().rpartition("Content-Length: ")[2])
            out.append((number(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], number(headers.get("WARC-Refers-To"))))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    def load(batches):
        last, file, table = None, None, []
        try:
            for batch in batches:
                for path, frame in zip(*(c.to_pylist() for c in batch.columns)):
                    if path != last:
                        if file is not None:
                            file.close()
                        last, file = path, files.opened(path)
                        table = seek_table(file)
                    offset, packed, _ = table[frame]
                    yield rows_of(frame_bytes(file, offset, packed), path)
        finally:
            if file is not None:
                file.close()

    return frames(index).mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def frames(index: DataFrame) -> DataFrame:
    """Rows (path, frame) of the index, dealt over an explicit number of partitions and sorted in each.

    Dealt by a hash of its own: with the columns of distinct() Spark would take its exchange for this one and coalesce it.
    """
    parts = shared.partitions(index.sparkSession)
    return index.select("path", "frame").distinct().repartition(parts, F.xxhash64("path", "frame")).sortWithinPartitions("path", "frame")
