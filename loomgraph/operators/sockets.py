"""Sockets of nodes and flows: node_id, process, pid, name, local_address, local_port, remote_address, remote_port, protocol, state."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import predicates
from loomgraph.functions.fields import Fields
from loomgraph.operators.values import Values

if TYPE_CHECKING:
    from loomgraph.operators.elements import Nodes
    from loomgraph.operators.flows import Flows
    from loomgraph.plans.graph import Graph

#: Names of the socket fields.
NAMES = {
    "Process": "process", "Pid": "pid", "Name": "name", "LocalAddress": "local_address", "LocalPort": "local_port",
    "RemoteAddress": "remote_address", "RemotePort": "remote_port", "Protocol": "protocol", "State": "state",
}


@dataclass
class Sockets:
    """Sockets with *key*, the node's id or the flow's uuid."""

    graph: "Graph"
    df: DataFrame

    @property
    def fields(self) -> Fields:
        return Fields(self.df.schema, metadata=None, roots=NAMES)

    def Has(self, *args: Any) -> "Sockets":
        return Sockets(self.graph, self.df.filter(predicates.has(self.fields, args)))

    def HasEither(self, *args: Any) -> "Sockets":
        return Sockets(self.graph, self.df.filter(predicates.has_either(self.fields, args)))

    def Values(self, key: str) -> Values:
        if key not in NAMES:
            raise KeyError(f"sockets have no field {key}")
        return Values(self.df.select(F.col(NAMES[key]).alias("value"), F.col("key").alias("_pos")))

    def Count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))


def _table(graph: "Graph") -> DataFrame:
    if graph.sockets is None:
        raise ValueError("the graph has no sockets")
    return graph.sockets


def of_nodes(nodes: "Nodes") -> Sockets:
    ids = nodes.df.select(F.col("id").alias("node_id"))
    sockets = _table(nodes.graph)
    return Sockets(nodes.graph, ids.join(sockets, "node_id").select(F.col("node_id").alias("key"), *sockets.columns))


def of_flows(flows: "Flows") -> Sockets:
    """Sockets whose addresses, ports and protocol are a TCP or UDP flow's, in either direction: one equi-join."""
    sockets = _table(flows.graph)
    ours = flows.df.filter(F.col("transport.protocol").isin("TCP", "UDP")).select(
        F.col("uuid").alias("key"), F.col("transport.protocol").alias("protocol"), F.explode(F.array(_ends("a", "b"), _ends("b", "a"))).alias("e"))
    ours = ours.select("key", "protocol", "e.*").distinct()
    on = ["protocol", "local_address", "local_port", "remote_address", "remote_port"]
    return Sockets(flows.graph, ours.join(sockets, on).select("key", *sockets.columns))


def _ends(a: str, b: str) -> Column:
    return F.struct(
        F.col(f"network.{a}").alias("local_address"), F.col(f"transport.{a}").alias("local_port"),
        F.col(f"network.{b}").alias("remote_address"), F.col(f"transport.{b}").alias("remote_port"))
