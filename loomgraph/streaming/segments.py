"""TCP segments in sequence: what arrived again, what is missing, and what came late.

A segment row has flow_key, direction, at (ms), seq (0 to 2**32 - 1), length (bytes of payload) and flags.  Sequence numbers
are unwrapped along the time: each one is taken to lie within 2**31 of the one before it, so a stream may be longer
than 4 GB and may begin anywhere.  ``batch`` finds the covered intervals by two windows, one along the time and one
along the sequence; ``stream`` keeps the merged intervals of each side as state, and its results on a finite input equal the
batch's if rows of earlier times don't come in later micro-batches.

Of each flow and direction: segments, bytes (distinct ones), retransmitted (bytes that were there already), missing (bytes in
holes) and skipped (holes), late (segments that begin below what was reached before), out_of_order (their new
bytes), saw_start (a SYN), saw_end (a FIN or RST).  A SYN takes one number before the payload.  Segments of one time are in order of
seq, then length.  Rows with a null among their first five columns aren't segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.functions import layers
from loomgraph.streaming.flowtable import EXPIRE
from loomgraph.streaming.fragments import merged

SCHEMA = "flow_key string, direction string, segments long, bytes long, retransmitted long, missing long, skipped long, late long, out_of_order long, saw_start boolean, saw_end boolean"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_ROWS = " and ".join(f"{c} is not null" for c in ("flow_key", "direction", "at", "seq", "length"))
TURN, HALF = 1 << 32, 1 << 31


def of_packets(raw: DataFrame) -> DataFrame:
    """Segment rows of raw packets (timestamp, data, link_type): of the innermost TCP header of each packet that has one."""
    rows = layers.walked(raw)
    last = lambda *names: F.element_at(F.filter("layers", lambda x: x["name"].isin(*names)), -1)
    rows = rows.filter(F.exists("layers", lambda x: x["name"] == layers.TCP))
    rows = layers.once(rows, "_of", F.struct(last(layers.IPV4, layers.IPV6).alias("ip"), last(layers.TCP).alias("tcp")))
    ip, tcp = F.col("_of.ip.at"), F.col("_of.tcp.at")
    four = F.col("_of.ip.name") == layers.IPV4
    told = F.when(four, layers.number(ip + 2, 2)).otherwise(layers.number(ip + 4, 2) + 40)
    stop = F.when(F.when(four, told > 0).otherwise(told > 40), F.least(ip + told, F.octet_length("data"))).otherwise(F.octet_length("data"))
    address = lambda a, b: F.when(four, layers.bytes_text(ip + a, 4)).otherwise(layers.bytes_text(ip + b, 16))
    bits = layers.number(tcp + 13, 1)
    flags = F.concat_ws("|", *[F.when(bits.bitwiseAND(b) != 0, F.lit(n)) for b, n in layers.FLAGS.items()])
    here = F.concat_ws("/", address(12, 8), layers.number(tcp, 2).cast("string"))
    there = F.concat_ws("/", address(16, 24), layers.number(tcp + 2, 2).cast("string"))
    return rows.select(
        F.concat_ws("-", F.least(here, there), F.greatest(here, there)).alias("flow_key"), F.when(here <= there, "AB").otherwise("BA").alias("direction"), F.col("timestamp").alias("at"),
        layers.number(tcp + 4, 4).alias("seq"), F.greatest(stop - tcp - F.col("_of.tcp.size"), F.lit(0)).cast("long").alias("length"), flags.alias("flags"))


def batch(segments: DataFrame) -> DataFrame:
    """One row (SCHEMA) for each flow and direction."""
    rows = segments.filter(_ROWS).withColumn("flags", F.coalesce("flags", F.lit("")))
    time = W.partitionBy("flow_key", "direction").orderBy("at", "seq", "length", "flags")
    step = F.pmod(F.col("seq") - F.lag("seq").over(time) + HALF, F.lit(TURN)) - HALF
    rows = rows.withColumn("_step", F.coalesce(step, F.col("seq")))
    sofar, before = time.rowsBetween(W.unboundedPreceding, 0), time.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_begin", F.sum("_step").over(sofar) + F.col("flags").contains("SYN").cast("long"))
    rows = rows.withColumn("_end", F.col("_begin") + F.col("length"))
    rows = rows.withColumn("_top", F.max("_end").over(before))
    along = W.partitionBy("flow_key", "direction").orderBy("_begin", "_end").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_to", F.coalesce(F.max("_end").over(along), F.col("_begin")))
    below = lambda edge: F.greatest(F.least("_end", edge) - F.col("_begin"), F.lit(0))
    again, under = F.sum(below("_to")), F.sum(F.when(F.col("_top").isNull(), 0).otherwise(below("_top")))
    hole = F.greatest(F.col("_begin") - F.col("_to"), F.lit(0))
    out = rows.groupBy("flow_key", "direction").agg(
        F.count(F.lit(1)).alias("segments"), (F.sum("length") - again).alias("bytes"), again.alias("retransmitted"), F.sum(hole).alias("missing"), F.count_if(hole > 0).alias("skipped"),
        F.count_if(F.col("_begin") < F.col("_top")).alias("late"), (under - again).alias("out_of_order"),
        F.bool_or(F.col("flags").contains("SYN")).alias("saw_start"), F.bool_or(F.col("flags").contains("FIN") | F.col("flags").contains("RST")).alias("saw_end"))
    return out.select(*[F.col(c).cast(t) for c, t in (x.split() for x in SCHEMA.split(", "))])


class SegmentProcessor(StatefulProcessor):
    """State of a side of a flow: its merged intervals, where it is, and counters."""

    def __init__(self, expire: int = EXPIRE):
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.intervals = handle.getListState("intervals", "begin long, end long")
        self.counters = handle.getValueState("counters", "seq long, place long, top long, last long, segments long, total long, late long, under long, saw_start boolean, saw_end boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.intervals.get()] if self.intervals.exists() else []
        state = list(self.counters.get()) if self.counters.exists() else [None, None, None, 0, 0, 0, 0, 0, False, False]
        for at, seq, length, flags in sorted(r for frame in rows for r in frame[["at", "seq", "length", "flags"]].itertuples(index=False, name=None)):
            state[1] = seq if state[0] is None else state[1] + (seq - state[0] + HALF) % TURN - HALF
            state[0] = seq
            begin = state[1] + ("SYN" in flags)
            end = begin + length
            if state[2] is not None:
                state[6] += begin < state[2]
                state[7] += max(min(end, state[2]) - begin, 0)
            state[2] = end if state[2] is None else max(state[2], end)
            state[3], state[4], state[5] = max(state[3], at), state[4] + 1, state[5] + length
            state[8], state[9] = state[8] or "SYN" in flags, state[9] or "FIN" in flags or "RST" in flags
            held.append((begin, end))
        held = merged(held)
        self.intervals.put([(int(a), int(b)) for a, b in held])
        self.counters.update(tuple(bool(x) if i > 7 else int(x) for i, x in enumerate(state)))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(state[3]) + self.expire)
        yield pd.DataFrame([], columns=_COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held, state = [tuple(r) for r in self.intervals.get()], self.counters.get()
        self.intervals.clear()
        self.counters.clear()
        covered = sum(b - a for a, b in held)
        again = state[5] - covered
        yield pd.DataFrame([[*key, state[4], covered, again, held[-1][1] - held[0][0] - covered, len(held) - 1, state[6], state[7] - again, state[8], state[9]]], columns=_COLUMNS)

    def close(self) -> None:
        pass


def stream(segments: DataFrame, expire: int = EXPIRE, delay: str = "1 minute") -> DataFrame:
    """The rows of :func:`batch` from a stream, told once a side has been idle for *expire*; the state store must be RocksDB."""
    rows = segments.filter(_ROWS).select("flow_key", "direction", "at", "seq", "length", F.coalesce("flags", F.lit("")).alias("flags"))
    rows = rows.withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", delay)
    return rows.groupBy("flow_key", "direction").transformWithStateInPandas(statefulProcessor=SegmentProcessor(expire), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
