"""Metric series: points (key, start, last, counters) and their aggregation into time buckets.

A point that crosses a bucket's end is split there: each counter's part before the end is its share
by time, cut off to an integer, and the rest goes on to the next bucket.  What lies before the first
bucket is dropped.  If a bucket's part is zero in all counters and the point begins in the bucket, the
whole point counts there.  Each point is folded over its buckets on its own, inside the JVM, so a long
series is not gathered in one task; buckets are then added up with partial sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.flows import COUNTERS, METRIC_FIELDS

if TYPE_CHECKING:
    from loomgraph.operators.elements import Nodes
    from loomgraph.operators.flows import Flows
    from loomgraph.plans.graph import Graph

#: Bucket length in seconds, and the most buckets of a result.
SLICE, MOST = 30, 10_000
#: Node fields that hold interface metrics.
NODE_FIELDS = ["LastUpdateMetric", "SFlow.LastUpdateMetric", "Ovs.LastUpdateMetric"]

#: Counters of an interface metric.
INTERFACE_COUNTERS = [
    "Collisions", "Multicast", "RxBytes", "RxCompressed", "RxCrcErrors", "RxDropped", "RxErrors", "RxFifoErrors", "RxFrameErrors", "RxLengthErrors", "RxMissedErrors", "RxOverErrors", "RxPackets",
    "TxAbortedErrors", "TxBytes", "TxCarrierErrors", "TxCompressed", "TxDropped", "TxErrors", "TxFifoErrors", "TxHeartbeatErrors", "TxPackets", "TxWindowErrors",
]


@dataclass
class Metrics:
    graph: "Graph"
    df: DataFrame
    counters: list[str]

    def Count(self) -> DataFrame:
        """The number of series."""
        return self.df.agg(F.count_distinct("key").alias("count"))

    def Keys(self) -> list[str]:
        return sorted([k for k, v in METRIC_FIELDS.items() if v in self.df.columns] or self.counters)

    def Sum(self, key: str | None = None) -> DataFrame:
        """A counter's sum; without a key one metric of all: counters added, earliest start, latest last."""
        if key is not None:
            name = METRIC_FIELDS.get(key, key)
            if name not in self.df.columns:
                raise KeyError(f"metrics have no field {key}")
            return self.df.agg(F.coalesce(F.sum(name), F.lit(0)).alias("sum"))
        return self.df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in self.counters], F.min("start").alias("start"), F.max("last").alias("last"))

    def Aggregates(self, seconds: int = SLICE, ordered: bool = False) -> "Metrics":
        """One series ``Aggregated`` with a point for each bucket that a point fell into.

        Points of one series that overlap are added, each over its own buckets.  With *ordered* a series is folded one point after
        another, as :func:`folded` says: what lies before the bucket that the points before have reached is lost.
        """
        length = seconds * 1000
        if self.graph.slice is not None:
            first, last = self.graph.slice.start, self.graph.slice.last
        else:
            first, last = self.df.agg(F.min("start"), F.max("last")).first()
        if first is None:
            return Metrics(self.graph, self.df.limit(0), self.counters)
        steps = -(-(last - first) // length)
        if steps > MOST:
            raise ValueError(f"more than {MOST} buckets")
        return Metrics(self.graph, (folded if ordered else bucketed)(self.df, self.counters, first, last, length, steps), self.counters)


def folded(points: DataFrame, counters: list[str], first: int, last: int, length: int, steps: int) -> DataFrame:
    """The rows of :func:`bucketed`, by an ordered fold of each series (by start, last, counters).

    A series has a bucket that it has reached.  Of a point what lies before that bucket is dropped; its part inside is counted, and the bucket moves on
    with what is left.  A point that lies wholly before the bucket, or counts nothing, ends its series.  Where a part is cut off to zero in
    the bucket where it begins, the whole rest counts there.

    Series are sorted inside the partitions of a shuffle by key, and read as a stream that carries the bucket from row to row: a long series takes
    time of one task, but no memory.  Sums of a batch's buckets go on, and are added up with partial sums.
    """
    n = len(counters)

    def split(v: list[int], s: int, e: int, cut: int):
        """The parts (counters, start, last) before and after a time."""
        if cut <= s:
            return None, (v, s, e)
        if cut >= e or s == e:
            return (v, s, e), None
        part = [int(float(x) * (float(cut - s) / float(e - s))) for x in v]
        return (part, s, cut), ([x - y for x, y in zip(v, part)], cut, e)

    def run(frames):
        key, j = None, 0
        for frame in frames:
            sums: dict[int, list[int]] = {}
            for k, s, e, *v in frame.itertuples(index=False, name=None):
                if k != key:
                    key, j = k, 0
                rest = (v, s, e)
                while rest is not None and j < steps:
                    low = first + j * length
                    high = min(low + length, last)
                    own = rest
                    _, here = split(*own, low)
                    if here is None or not any(here[0]):
                        j = steps  # no later bucket can take it
                        break
                    part, after = split(*here, high)
                    if part is None:
                        j = max(j + 1, min((here[1] - first) // length, steps))
                        continue
                    if not any(part[0]) and low <= own[1] < high:
                        part, after = own, None
                    held = sums.setdefault(j, [0] * n)
                    for i, x in enumerate(part[0]):
                        held[i] += x
                    rest = after if after is not None and any(after[0]) else None
            yield pd.DataFrame([(i, *held) for i, held in sums.items()], columns=["i", *counters])

    rows = points.filter("start is not null and last is not null").select("key", F.col("start").cast("long"), F.col("last").cast("long"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counters])
    parts = rows.repartition("key").sortWithinPartitions("key", "start", "last", *counters).mapInPandas(run, "i long, " + ", ".join(f"`{c}` long" for c in counters))
    out = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in counters])
    return out.select(F.lit("Aggregated").alias("key"), (first + F.col("i") * length).alias("start"), F.least(first + (F.col("i") + 1) * length, F.lit(max(last, first + length))).alias("last"), *counters)


def bucketed(points: DataFrame, counters: list[str], first: int, last: int, length: int, steps: int) -> DataFrame:
    """Rows (key, start, last, counters) of the buckets [first + i * length, first + (i + 1) * length)."""
    kind = "struct<at:bigint,left:array<bigint>,done:boolean,out:array<struct<i:bigint,part:array<bigint>>>>"
    values = "array(" + ", ".join(f"cast({c} as bigint)" for c in counters) + ")"
    share = "transform({v}, x -> cast(x * ({cut} - {s}) / (last - {s}) as bigint))"
    rest = "zip_with({v}, {part}, (x, y) -> x - y)"
    inside = points.filter((F.col("last") > first) | (F.col("last") == F.col("start")) & (F.col("last") >= first)).filter(F.col("start") < last)
    begin = inside.withColumn("_v", F.expr(values))
    before = share.format(v="_v", cut=first, s="start")
    begin = begin.withColumn("_v0", F.expr(f"if(start < {first}, {rest.format(v='_v', part=before)}, _v)")).withColumn("_s", F.greatest("start", F.lit(first)))
    low = f"least(({'_s'} - {first}) div {length}, {steps - 1})"
    high = f"least(greatest({low}, (last - {first} - 1) div {length}), {steps - 1})"
    end = f"({first} + (i + 1) * {length})"
    part = f"if(last <= {end} or i = {steps - 1} and last <= {last}, a.left, transform(a.left, x -> cast(x * ({end} - a.at) / (last - a.at) as bigint)))"
    zero = "not exists(part, x -> x <> 0)"
    whole = f"({zero} and start >= {first} + i * {length} and start < {end})"
    step = (
        f"element_at(transform(array({part}), part -> named_struct('at', {end}, 'left', {rest.format(v='a.left', part='part')}, 'done', {whole}, "
        f"'out', concat(a.out, array(named_struct('i', i, 'part', if({whole}, _v, part)))))), 1)"
    )
    fold = f"aggregate(sequence({low}, {high}), cast(named_struct('at', _s, 'left', _v0, 'done', false, 'out', array()) as {kind}), (a, i) -> cast(if(a.done, a, {step}) as {kind}), a -> a.out)"
    parts = begin.select(F.explode(F.expr(fold)).alias("b")).select("b.i", *[F.col("b.part")[n].alias(c) for n, c in enumerate(counters)])
    out = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in counters])
    return out.select(F.lit("Aggregated").alias("key"), (first + F.col("i") * length).alias("start"), F.least(first + (F.col("i") + 1) * length, F.lit(max(last, first + length))).alias("last"), *counters)


def of_flows(flows: "Flows") -> Metrics:
    """Live: each flow's last update, or else its whole metric.  In a slice: the stored points inside it."""
    graph = flows.graph
    if graph.slice is None or graph.flow_metrics is None:
        whole = F.coalesce("last_update_metric", "metric") if "last_update_metric" in flows.df.columns else F.col("metric")
        points = flows.df.select(F.col("uuid").alias("key"), whole.alias("m")).filter("m is not null").select("key", *[F.col(f"m.{c}") for c in ["start", "last", *COUNTERS]])
        return Metrics(graph, points, COUNTERS)
    inside = graph.flow_metrics.filter((F.col("start") >= graph.slice.start) & (F.col("last") <= graph.slice.last))
    points = inside.join(flows.df.select(F.col("uuid").alias("flow_uuid")).distinct(), "flow_uuid", "left_semi")
    return Metrics(graph, points.select(F.col("flow_uuid").alias("key"), "start", "last", *COUNTERS), COUNTERS)


def stored_points(graph: "Graph") -> Metrics:
    """All stored points of a graph's flows, inside its slice if it has one."""
    points = graph.flow_metrics.select(F.col("flow_uuid").alias("key"), "start", "last", *COUNTERS)
    if graph.slice is not None:
        points = points.filter((F.col("start") >= graph.slice.start) & (F.col("last") <= graph.slice.last))
    return Metrics(graph, points, COUNTERS)


def of_nodes(nodes: "Nodes", field: str) -> Metrics:
    """A point for each node and start, from the metadata; in a slice, points strictly inside it."""
    if field not in NODE_FIELDS and field not in [f.split(".")[0] for f in NODE_FIELDS]:
        raise ValueError(f"nodes have no metric {field}")
    found = nodes.fields.find(field if field in NODE_FIELDS else f"{field}.LastUpdateMetric")
    if found is not None and isinstance(found[1], T.VariantType):  # open metadata: of the known counters those that a node lacks are 0
        counters = INTERFACE_COUNTERS
        read = F.try_variant_get(found[0], "$", "map<string,bigint>")
        value = lambda name: F.try_element_at(F.col("_m"), F.lit(name))
        points = nodes.df.select(F.col("id").alias("key"), read.alias("_m")).filter("_m is not null")
        points = points.select("key", value("Start").alias("start"), value("Last").alias("last"), *[F.coalesce(value(c), F.lit(0)).alias(c) for c in counters]).dropDuplicates(["key", "start"])
        if nodes.graph.slice is not None:
            points = points.filter((F.col("start") > nodes.graph.slice.start) & (F.col("last") < nodes.graph.slice.last))
        return Metrics(nodes.graph, points, counters)
    if found is None or not isinstance(found[1], T.StructType):
        raise KeyError(f"nodes have no metric {field}")
    column, kind = found
    counters = [n for n in kind.names if n not in ("Start", "Last")]
    points = nodes.df.filter(column.isNotNull()).select(F.col("id").alias("key"), column["Start"].alias("start"), column["Last"].alias("last"), *[column[c].alias(c) for c in counters])
    points = points.dropDuplicates(["key", "start"])
    if nodes.graph.slice is not None:
        points = points.filter((F.col("start") > nodes.graph.slice.start) & (F.col("last") < nodes.graph.slice.last))
    return Metrics(nodes.graph, points, counters)


# The algebra of two metrics with equal counters, as struct Columns.


def add(a, b, counters: list[str] = COUNTERS):
    return F.struct(*[(a[c] + b[c]).alias(c) for c in counters], F.least(a["start"], b["start"]).alias("start"), F.greatest(a["last"], b["last"]).alias("last"))


def sub(a, b, counters: list[str] = COUNTERS):
    return F.struct(*[(a[c] - b[c]).alias(c) for c in counters], a["start"].alias("start"), a["last"].alias("last"))


def split(a, cut, counters: list[str] = COUNTERS):
    """The parts of a metric before and after an instant, as a struct of two; a part is null where the metric lies on one side.

    The earlier part's counters are its share by time, cut off to integers; the later part is the rest.
    """
    ratio = (cut - a["start"]).cast("double") / (a["last"] - a["start"])
    share = lambda c: (a[c].cast("double") * ratio).cast("bigint")
    left = F.struct(*[share(c).alias(c) for c in counters], a["start"].alias("start"), cut.alias("last"))
    right = F.struct(*[(a[c] - share(c)).alias(c) for c in counters], cut.alias("start"), a["last"].alias("last"))
    whole = F.struct(*[a[c].alias(c) for c in counters], a["start"].alias("start"), a["last"].alias("last"))
    early = cut <= a["start"]
    late = ~early & ((cut >= a["last"]) | (a["start"] == a["last"]))
    return F.struct(F.when(late, whole).when(~early, left).alias("before"), F.when(early, whole).when(~late, right).alias("after"))


def is_zero(a, counters: list[str] = COUNTERS):
    out = F.lit(True)
    for c in counters:
        out = out & (a[c] == 0)
    return out
