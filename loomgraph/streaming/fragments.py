"""IP fragments: which datagrams are whole, what overlaps and what is missing, and the whole datagrams' packets.

A fragment row has network_a, network_b, protocol, ip_id, at (ms), begin, end (bytes of the payload) and more (whether
others follow).  Fragments of one key with gaps of at most *ttl* are one datagram.  ``batch`` merges byte ranges by windows;
``stream`` keeps the fragments of an open datagram as a list state, with a timer, and its results on a finite
input equal the batch's.

A datagram is whole if its ranges leave no hole between 0 and the end of its last fragment.  A fragment counts as an error
if it is no multiple of eight bytes and not the last one, ends beyond 65,535 bytes, or is empty; it covers nothing.  A row
with a null key column, time or range isn't a fragment.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.functions import layers

KEY = ["network_a", "network_b", "protocol", "ip_id"]
#: How long a datagram waits for its next fragment (ms), and the most bytes of one.
TTL, MOST = 30_000, 65_535
SCHEMA = "network_a string, network_b string, protocol long, ip_id long, start long, last long, fragments long, errors long, bytes long, overlapped long, missing long, whole boolean"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def of_packets(raw: DataFrame) -> DataFrame:
    """Fragment rows of raw packets (timestamp, data, link_type) whose outermost IPv4 header says so, with header and payload; other packets have none."""
    rows = layers.walked(raw)
    ip = F.try_element_at(F.filter("layers", lambda x: x["name"] == layers.IPV4), F.lit(1))
    rows = layers.once(rows, "_ip", ip).filter("_ip is not null")
    at = F.col("_ip.at")
    word = layers.number(at + 6, 2)
    size = F.col("_ip.size")
    begin = (word % 8192) * 8
    # bytes behind the datagram's length are padding of the link layer; a length of 0 is one that the sender left open
    told = layers.number(at + 2, 2)
    length = F.greatest(F.when(told > 0, F.least(told, F.octet_length("data") - at)).otherwise(F.octet_length("data") - at) - size, F.lit(0))
    address = lambda n: F.concat_ws(".", *[layers.number(at + n + i, 1).cast("string") for i in range(4)])
    rows = rows.withColumns({
        "network_a": address(12), "network_b": address(16), "protocol": layers.number(at + 9, 1), "ip_id": layers.number(at + 4, 2), "begin": begin.cast("long"), "end": (begin + length).cast("long"),
        "more": word.bitwiseAND(0x2000) != 0, "header": F.substring(F.col("data"), F.lit(1), at + size), "payload": F.substring(F.col("data"), at + size + 1, length.cast("int")), "_at": at})
    return rows.filter("more or begin > 0").select(*KEY, F.col("timestamp").alias("at"), "begin", "end", "more", "header", "payload", "link_type", F.col("_at").alias("ip_at"))


def _bad(begin: Column, end: Column, more: Column) -> Column:
    return (end <= begin) | (end > MOST) | more & ((end - begin) % 8 != 0)


def _numbered(fragments: DataFrame, ttl: int) -> DataFrame:
    """The fragments with _datagram: its number among those of its key."""
    rows = fragments.filter(" and ".join(f"{c} is not null" for c in [*KEY, "at", "begin", "end", "more"]))
    order = W.partitionBy(*KEY).orderBy("at")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(order) > ttl, F.lit(True)).cast("int")
    rows = rows.withColumn("_fresh", fresh)
    return rows.withColumn("_datagram", F.sum("_fresh").over(order.rangeBetween(W.unboundedPreceding, 0))).drop("_fresh").withColumn("_bad", _bad(F.col("begin"), F.col("end"), F.col("more")))


def batch(fragments: DataFrame, ttl: int = TTL) -> DataFrame:
    """One row (SCHEMA) for each datagram of which a fragment was seen."""
    rows = _numbered(fragments, ttl)
    along = W.partitionBy(*KEY, "_datagram", "_bad").orderBy("begin", "end").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_to", F.coalesce(F.max("end").over(along), F.lit(0)))
    good = ~F.col("_bad")
    overlapped = F.when(good, F.greatest(F.least("end", "_to") - F.col("begin"), F.lit(0))).otherwise(0)
    hole = F.when(good, F.greatest(F.col("begin") - F.col("_to"), F.lit(0))).otherwise(0)
    length = F.when(good, F.col("end") - F.col("begin")).otherwise(0)
    out = rows.groupBy(*KEY, "_datagram").agg(
        F.min("at").alias("start"), F.max("at").alias("last"), F.count(F.lit(1)).alias("fragments"), F.count_if("_bad").alias("errors"),
        F.sum(length - overlapped).alias("bytes"), F.sum(overlapped).alias("overlapped"), F.sum(hole).alias("missing"),
        F.coalesce(F.min(F.when(good & ~F.col("more"), F.col("end"))) == F.max(F.when(good, F.col("end"))), F.lit(False)).alias("_ended"))
    return out.withColumn("whole", F.col("_ended") & (F.col("missing") == 0)).select(*[F.col(c).cast(t) for c, t in (x.split() for x in SCHEMA.split(", "))])


def reassembled(raw: DataFrame, ttl: int = TTL) -> DataFrame:
    """Raw packets (timestamp, data, link_type) without fragments, each whole datagram as one packet at the time of its last fragment.

    Of overlapping bytes those of the fragment that begins first count.  The header is the first fragment's, with the datagram's length and
    no fragment bits.  A datagram has at most 64 KB: one aggregation row holds it.
    """
    fragments = _numbered(of_packets(raw), ttl).filter("not _bad")
    parts = fragments.groupBy(*KEY, "_datagram").agg(
        F.max("at").alias("timestamp"), F.array_sort(F.array_distinct(F.collect_list(F.struct("begin", "end", "payload")))).alias("parts"),
        F.min_by(F.struct("header", "link_type", "ip_at"), F.struct("begin", "at")).alias("first"), F.min(F.when(~F.col("more"), F.col("end"))).alias("stop"), F.max("end").alias("top"))
    zero = F.lit(bytearray())
    body = F.aggregate("parts", zero, lambda acc, x: F.when(x.begin > F.octet_length(acc), acc).otherwise(F.concat(acc, F.substring(x.payload, F.octet_length(acc) - x.begin.cast("int") + 1, F.octet_length(x.payload)))))
    parts = parts.withColumn("body", body).filter("stop is not null and stop = top and octet_length(body) = stop")
    at, header = F.col("first.ip_at"), F.col("first.header")
    piece = lambda a, n: F.substring(header, a + 1, n)
    length = F.octet_length(header) - at + F.octet_length("body")
    whole = F.concat(piece(F.lit(0), at + 2), F.unhex(F.lpad(F.hex(length), 4, "0")), piece(at + 4, F.lit(2)), F.unhex(F.lit("0000")), piece(at + 8, F.octet_length(header)), F.col("body"))
    ip = F.try_element_at(F.filter("layers", lambda x: x["name"] == layers.IPV4), F.lit(1))
    others = layers.walked(raw.select("timestamp", "data", "link_type")).filter(F.coalesce(layers.number(ip["at"] + 6, 2).bitwiseAND(0x3FFF) == 0, F.lit(True)))
    return others.select("timestamp", "data", "link_type").unionByName(parts.select("timestamp", whole.alias("data"), F.col("first.link_type").alias("link_type")))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges as few as can be, in order; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((begin, end))
    return out


class FragmentProcessor(StatefulProcessor):
    """State of a key: the fragments of its open datagram."""

    def __init__(self, ttl: int = TTL):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("fragments", "at long, begin long, end long, more boolean")

    def told(self, key: Any, rows: list[tuple]) -> list:
        bad = [e <= b or e > MOST or m and (e - b) % 8 != 0 for _, b, e, m in rows]
        good = [r for r, x in zip(rows, bad) if not x]
        ranges = merged([(b, e) for _, b, e, _ in good])
        covered = sum(e - b for b, e in ranges)
        missing = (ranges[-1][1] - covered) if ranges else 0
        stops = [e for _, _, e, m in good if not m]
        whole = bool(stops) and min(stops) == ranges[-1][1] and missing == 0
        return [*key, min(r[0] for r in rows), max(r[0] for r in rows), len(rows), sum(bad), covered, sum(e - b for _, b, e, _ in good) - covered, missing, whole]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        done = []
        for row in sorted(r for frame in rows for r in frame[["at", "begin", "end", "more"]].itertuples(index=False, name=None)):
            if held and row[0] - max(r[0] for r in held) > self.ttl:
                done.append(self.told(key, held))
                held = []
            held.append((int(row[0]), int(row[1]), int(row[2]), bool(row[3])))
        self.open.put(held)
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(r[0] for r in held) + self.ttl)
        yield pd.DataFrame(done, columns=_COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        self.open.clear()
        yield pd.DataFrame([self.told(key, held)] if held else [], columns=_COLUMNS)

    def close(self) -> None:
        pass


def stream(fragments: DataFrame, ttl: int = TTL, delay: str = "1 minute") -> DataFrame:
    """The rows of :func:`batch` from a stream of fragments, in event time; the state store must be RocksDB."""
    rows = fragments.filter(" and ".join(f"{c} is not null" for c in [*KEY, "at", "begin", "end", "more"])).select(*KEY, "at", "begin", "end", "more")
    rows = rows.withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", delay)
    return rows.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=FragmentProcessor(ttl), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
