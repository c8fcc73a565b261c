"""Periodic updates of open flows: what each flow has counted so far, and what it gained since the update before.

Updates are at multiples of *seconds* of event time.  A flow that got packets since the last multiple has an update row:
flow_key, start and last (of the flow so far), its counters so far (ab_packets ...), and the gain (update_ab_packets ...)
between update_start (the multiple before, or the flow's start in its first update) and update_last.  The gains of a flow add up to
its final counters.  Flows are cut as in ``flowtable``: by idle times and the hold of flows that begin with FIN or RST; a
flow that ends inside an interval, and its successor, have a row each.

``batch`` adds up windows.  ``stream`` holds a key's packets until the watermark has passed the end of their interval and a timer
takes them in order, so packets may come in any order within the delay and the rows equal the batch's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.streaming import flowtable
from loomgraph.streaming.flowtable import EXPIRE, FIN, HOLD, RST, TIMEOUT

COUNTERS = ("ab_packets", "ab_bytes", "ba_packets", "ba_bytes")
SCHEMA = "flow_key string, start long, last long, " + ", ".join(f"{c} long" for c in COUNTERS) + ", " + ", ".join(f"update_{c} long" for c in COUNTERS) + ", update_start long, update_last long"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def batch(packets: DataFrame, seconds: int = 60, expire: int = EXPIRE, hold: int = HOLD) -> DataFrame:
    """The update rows of all flows."""
    ms = seconds * 1000
    names = [c for c in ("flow_key", "direction", "at", "bytes", "application", "flags") if c in packets.columns]
    rows = flowtable.sessions(packets.select(*names), expire, hold)
    ab = F.col("direction") == "AB"
    gained = rows.groupBy("flow_key", "_flow", (F.floor(F.col("at") / ms) * ms).cast("long").alias("_slot")).agg(
        F.min("at").alias("_first"), F.max("at").alias("_last"),
        F.count_if(ab).alias("update_ab_packets"), F.sum(F.when(ab, F.col("bytes")).otherwise(0)).alias("update_ab_bytes"),
        F.count_if(~ab).alias("update_ba_packets"), F.sum(F.when(~ab, F.col("bytes")).otherwise(0)).alias("update_ba_bytes"))
    sofar = W.partitionBy("flow_key", "_flow").orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    told = gained.withColumns({"start": F.min("_first").over(sofar), "last": F.max("_last").over(sofar)} | {c: F.sum(f"update_{c}").over(sofar) for c in COUNTERS})
    told = told.withColumns({"update_start": F.greatest("_slot", "start"), "update_last": F.col("_slot") + ms})
    return told.select(*[F.col(c).cast(t) for c, t in (x.split() for x in SCHEMA.split(", "))])


class UpdateProcessor(StatefulProcessor):
    """State of a key: packets of intervals that aren't over, and its open flow with what it had at its last update."""

    def __init__(self, seconds: int, expire: int = EXPIRE, hold: int = HOLD):
        self.ms, self.expire, self.hold = seconds * 1000, expire, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("packets", "at long, direction string, bytes long, flags string, application string")
        fields = "start long, last long, ab_packets long, ab_bytes long, ba_packets long, ba_bytes long, finish string, application string"
        self.flow = handle.getValueState("flow", fields)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        for frame in rows:  # frame by frame: a key's packets of a micro-batch are never one frame
            frame = frame[["at", "direction", "bytes", "flags", "application"]].astype(object).where(lambda x: x.notna(), None)
            new = [(int(a), d, int(b), f, p) for a, d, b, f, p in frame.itertuples(index=False, name=None)]
            self.waiting.appendList(new)
            for due in {(r[0] // self.ms + 1) * self.ms for r in new} - known:
                self.handle.registerTimer(due)
                known.add(due)
        yield pd.DataFrame([], columns=_COLUMNS)

    def limit(self, flow: list) -> int:
        idle = flowtable.APPLICATION_EXPIRE.get(flow[7], self.expire)
        return idle if flow[6] == TIMEOUT else min(idle, self.hold - 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        waiting = [tuple(r) for r in self.waiting.get()]
        now = sorted((r for r in waiting if r[0] < due), key=lambda r: (r[0], r[4] is not None, r[4] or "", r[3] is not None, r[3] or ""))
        rest = [r for r in waiting if r[0] >= due]
        flow = list(self.flow.get()) if self.flow.exists() else None
        before, out = flow[2:6] if flow else None, []

        def tell() -> None:
            gain = [a - b for a, b in zip(flow[2:6], before)]
            if any(gain[i] for i in (0, 2)):
                out.append([key[0], *flow[:6], *gain, max(due - self.ms, flow[0]), due])

        for at, direction, size, flags, application in now:
            if flow is not None and at - flow[1] > self.limit(flow):
                tell()
                flow = None
            if flow is None:
                flags = flags or ""
                flow, before = [at, at, 0, 0, 0, 0, RST if "RST" in flags else FIN if "FIN" in flags else TIMEOUT, application], [0, 0, 0, 0]
            flow[1], flow[7] = at, application
            n = 2 if direction == "AB" else 4
            flow[n], flow[n + 1] = flow[n] + 1, flow[n + 1] + size
        if flow is not None:
            tell()
        if flow is not None and (rest or due - flow[1] <= self.limit(flow)):
            self.flow.update(tuple(flow))
            if not rest and not [t for t in self.handle.listTimers() if t > due]:
                self.handle.registerTimer((flow[1] + self.limit(flow)) // self.ms * self.ms + self.ms)  # to forget it, if nothing comes
        else:
            self.flow.clear()
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def stream(packets: DataFrame, seconds: int = 60, expire: int = EXPIRE, hold: int = HOLD, delay: str = "1 minute") -> DataFrame:
    """The rows of :func:`batch` from a stream of packets; the state store must be RocksDB."""
    rows = packets
    for name in ("flags", "application"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    rows = rows.select("flow_key", "direction", "at", "bytes", "flags", "application").withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", delay)
    return rows.groupBy("flow_key").transformWithStateInPandas(statefulProcessor=UpdateProcessor(seconds, expire, hold), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
