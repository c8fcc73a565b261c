"""Steps on flows.

A flow row has nested layers (link, network, transport, icmp) and metrics.  Conditions come first, then
sort, dedup and range, in the order written.  Joins to nodes are equi-joins on a hardware address or a
topology id; the first match, the smallest node id, is chosen on the side of the nodes, before the join.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import predicates
from loomgraph.functions.fields import Fields
from loomgraph.operators.values import Values

if TYPE_CHECKING:
    from loomgraph.operators.elements import Nodes
    from loomgraph.plans.graph import Graph

#: Names of the flow fields, as in the public schema of flows.
ROOTS = {
    "UUID": "uuid", "LayersPath": "layers_path", "Application": "application", "TrackingID": "tracking_id", "L3TrackingID": "l3_tracking_id",
    "ParentUUID": "parent_uuid", "NodeTID": "node_tid", "CaptureID": "capture_id", "Start": "start", "Last": "last", "FinishType": "finish_type",
    "RawPacketsCaptured": "raw_packets_captured",
}
LAYERS = {"Link": "link", "ETHERNET": "link", "Network": "network", "IPV4": "network", "IPV6": "network", "Transport": "transport", "TCP": "transport", "UDP": "transport", "SCTP": "transport", "ICMP": "icmp"}
LAYER_FIELDS = {"Protocol": "protocol", "A": "a", "B": "b", "ID": "id", "Type": "type", "Code": "code"}
COUNTERS = ["ab_packets", "ab_bytes", "ba_packets", "ba_bytes"]
METRIC_FIELDS = {"ABPackets": "ab_packets", "ABBytes": "ab_bytes", "BAPackets": "ba_packets", "BABytes": "ba_bytes", "Start": "start", "Last": "last", "RTT": "rtt"}
METRICS = {"Metric": "metric", "LastUpdateMetric": "last_update_metric"}
NAMES = ROOTS | {f"{a}.{b}": f"{LAYERS[a]}.{LAYER_FIELDS[b]}" for a in LAYERS for b in LAYER_FIELDS} | {f"{a}.{b}": f"{METRICS[a]}.{METRIC_FIELDS[b]}" for a in METRICS for b in METRIC_FIELDS}
#: A layer's name alone means either side.
SIDES = {"Link": ("Link.A", "Link.B"), "Network": ("Network.A", "Network.B"), "Transport": ("Transport.A", "Transport.B")}
#: Types of nodes on which flows can be captured.
CAPTURE_TYPES = ["afpacket", "bond", "bridge", "can", "device", "dummy", "gre", "gretap", "host", "intel-xdp", "internal", "ipvlan", "macvlan", "ovsbridge", "ovsport", "patch", "tap", "tun", "tuntap", "veth", "vlan", "vxlan"]
ASC, DESC = "ASC", "DESC"


@dataclass
class Flows:
    graph: "Graph"
    df: DataFrame
    order: tuple[Column, ...] = ()

    @property
    def fields(self) -> Fields:
        return Fields(self.df.schema, metadata=None, roots={k: v for k, v in NAMES.items() if v.split(".")[0] in self.df.columns})

    def filter(self, condition: Column) -> "Flows":
        return replace(self, df=self.df.filter(condition))

    def _test(self, key: str, value: Any) -> Column:
        return predicates.or_(*(predicates.test(self.fields, k, value) for k in SIDES.get(key, (key,))))

    def Has(self, *args: Any) -> "Flows":
        if len(args) < 2:
            raise ValueError("Has of flows takes keys and values")
        return self.filter(predicates.and_(*(self._test(k, v) for k, v in predicates.pairs(args))))

    def HasEither(self, *args: Any) -> "Flows":
        if len(args) < 2:
            raise ValueError("HasEither of flows takes keys and values")
        return self.filter(predicates.or_(*(self._test(k, v) for k, v in predicates.pairs(args))))

    def Count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))

    def Sort(self, *args: str) -> "Flows":
        way, key = (args[0], args[1]) if len(args) == 2 else (ASC, args[0] if args else "Last")
        column = F.col(self._name(key))
        order = (column.desc() if way == DESC else column.asc(),)
        return replace(self, df=self.df.orderBy(*order, "uuid"), order=order)

    def _name(self, key: str) -> str:
        if key not in NAMES or self.fields.find(key) is None:
            raise KeyError(f"flows have no field {key}")
        return NAMES[key]

    def Range(self, start: int, stop: int) -> "Flows":
        return replace(self, df=self.df.orderBy(*self.order, "uuid").offset(start).limit(max(0, stop - start)))

    def Limit(self, n: int) -> "Flows":
        return self.Range(0, n)

    def Dedup(self, key: str = "TrackingID") -> "Flows":
        first = W.partitionBy(F.col(self._name(key))).orderBy(*self.order, "uuid")
        return replace(self, df=self.df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"))

    # values

    def Sum(self, key: str) -> DataFrame:
        """A metric's sum as a double; a flow without it is an error."""
        if key.split(".")[0] not in METRICS:
            raise ValueError("Sum of flows takes a metric's field")
        column = F.col(self._name(key))
        there = F.when(column.isNull(), F.raise_error(F.lit(f"a flow has no {key}")).cast("bigint")).otherwise(column)
        return self.df.agg(F.coalesce(F.sum(there).cast("double"), F.lit(0.0)).alias("sum"))

    def Values(self, key: str) -> Values:
        column = F.col(self._name(key))
        there = F.when(column.isNull(), F.raise_error(F.lit(f"a flow has no {key}")).cast(self.df.select(column).schema[0].dataType)).otherwise(column)
        return Values(self.df.select(there.alias("value"), F.col("uuid").alias("_pos")))

    def Keys(self) -> list[str]:
        """Names of the fields that flows have."""
        aliases = [k for k in LAYERS if k.isupper() and k != "ICMP"]
        return sorted(k for k in self.fields.roots if k.split(".")[0] not in aliases and self.fields.find(k) is not None)

    # groups

    def Group(self) -> "FlowGroups":
        return FlowGroups(self.graph, self.df.withColumn("group_key", F.col("tracking_id")))

    # nodes

    def _by_mac(self, side: str, args: tuple, names: tuple[str, ...] = ("MAC", "PeerIntfMAC")) -> DataFrame:
        seen = self.graph.V()
        nodes = seen.Has(*args) if args else seen
        macs = nodes.df.select("id", F.explode(F.array(*[nodes.fields.string(n) for n in names])).alias("_mac")).filter("_mac is not null")
        first = macs.groupBy("_mac").agg(F.min("id").alias("_id"))
        ids = self.df.select(F.col(f"link.{side}").alias("_mac")).join(first, "_mac").select("_id")
        return seen.df.join(ids, seen.df["id"] == ids["_id"]).select(*seen.df.columns)

    def _by_tid(self, args: tuple) -> DataFrame:
        seen = self.graph.V()
        nodes = seen.Has(*args) if args else seen
        tids = nodes.df.select("id", nodes.fields.string("TID").alias("_tid")).filter("_tid is not null").groupBy("_tid").agg(F.min("id").alias("_id"))
        ids = self.df.select(F.col("node_tid").alias("_tid")).join(tids, "_tid").select("_id")
        return seen.df.join(ids, seen.df["id"] == ids["_id"]).select(*seen.df.columns)

    def _nodes(self, *parts: DataFrame) -> "Nodes":
        from loomgraph.operators.elements import Nodes

        return Nodes(self.graph, reduce(DataFrame.unionByName, parts))

    def Out(self, *args: Any) -> "Nodes":
        """For each flow, the node that has its B address."""
        return self._nodes(self._by_mac("b", args))

    def In(self, *args: Any) -> "Nodes":
        return self._nodes(self._by_mac("a", args))

    def Both(self, *args: Any) -> "Nodes":
        return self._nodes(self._by_mac("a", args), self._by_mac("b", args))

    def Nodes(self, *args: Any) -> "Nodes":
        """For each flow, the node it was captured on and those that have its A and B address as MAC."""
        return self._nodes(self._by_tid(args), self._by_mac("a", args, ("MAC",)), self._by_mac("b", args, ("MAC",)))

    def Hops(self, *args: Any) -> "Nodes":
        """The nodes the flows were captured on."""
        return self._nodes(self._by_tid(args))

    CaptureNode = Hops
    Node = Hops

    # metrics, sockets, packets

    def Metrics(self):
        from loomgraph.operators import metrics

        return metrics.of_flows(self)

    def Sockets(self):
        from loomgraph.operators import sockets

        return sockets.of_flows(self)

    def RawPackets(self):
        from loomgraph.operators import rawpackets

        return rawpackets.of_flows(self)


@dataclass
class FlowGroups:
    """Flows with *group_key*."""

    graph: "Graph"
    df: DataFrame

    def Count(self) -> DataFrame:
        return self.df.agg(F.count_distinct("group_key").alias("count"))

    def MoreThan(self, n: int = 1) -> "FlowGroups":
        """Groups of more than *n* flows; counted by partial sums, not by gathering a group."""
        large = self.df.groupBy("group_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n).select("group_key")
        return FlowGroups(self.graph, self.df.join(large, "group_key", "left_semi"))


def of_nodes(nodes: "Nodes", args: tuple) -> Flows:
    """Flows captured on the nodes, of the types that allow it."""
    graph = nodes.graph
    able = nodes.df.filter(nodes.fields.string("Type").isin(CAPTURE_TYPES)).select(nodes.fields.string("TID").alias("node_tid")).filter("node_tid is not null").distinct()
    flows = graph.Flows(*args)
    return replace(flows, df=flows.df.join(able, "node_tid", "left_semi").select(*flows.df.columns))
