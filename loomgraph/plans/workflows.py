"""Library queries over several steps, and the registry for own ones.

A step or workflow of one's own is a function from a graph (and arguments) to a graph or frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.graph import Graph

WORKFLOWS: dict[str, Callable] = {}


def workflow(f: Callable) -> Callable:
    """Registers a function under its name."""
    WORKFLOWS[f.__name__] = f
    return f


def run(graph: Graph, name: str, *args):
    if name not in WORKFLOWS:
        raise KeyError(f"no workflow {name}")
    return WORKFLOWS[name](graph, *args)


@workflow
def flow_matrix(graph: Graph) -> DataFrame:
    """Which process talks to which: a socket joined with the one whose local end is its remote end."""
    a, b = graph.sockets, graph.sockets
    there = b.select(
        F.col("node_id").alias("server_node"), F.col("name").alias("server"), F.col("local_address").alias("remote_address"), F.col("local_port").alias("remote_port"),
        F.col("remote_address").alias("local_address"), F.col("remote_port").alias("local_port"), "protocol")
    pairs = a.select(F.col("node_id").alias("client_node"), F.col("name").alias("client"), "local_address", "local_port", "remote_address", "remote_port", "protocol").join(
        there, ["local_address", "local_port", "remote_address", "remote_port", "protocol"])
    return pairs.filter((F.col("client_node") != F.col("server_node")) & (F.col("remote_port") <= F.col("local_port"))).select("client_node", "client", "server_node", "server", F.col("remote_port").alias("port"), "protocol").distinct()


@workflow
def check_mtu(graph: Graph, source: dict, target: dict) -> DataFrame:
    """Paths from *source* to *target* on which a hop's MTU is smaller than the one before: (path_id, step, id, mtu, before)."""
    start = graph.V().Has(*[x for kv in source.items() for x in kv])
    paths = start.ShortestPathTo(target)
    nodes = graph.V()
    mtu = paths.df.join(nodes.df.select("id", nodes.fields.long("MTU").alias("mtu")), "id")
    steps = mtu.select(F.col("path_id"), (F.col("step") + 1).alias("step"), F.col("mtu").alias("before"))
    return mtu.join(steps, ["path_id", "step"]).filter("mtu < before").select("path_id", "step", "id", "mtu", "before")


@workflow
def check_connectivity(graph: Graph, source: dict, target: dict) -> DataFrame:
    """Sources that a path joins with the target: (id, hops)."""
    start = graph.V().Has(*[x for kv in source.items() for x in kv])
    return start.ShortestPathTo(target).df.groupBy("path_id").agg(F.min_by("id", "step").alias("id"), F.max("step").alias("hops")).select("id", "hops")


@workflow
def flow_validation(graph: Graph, *args) -> DataFrame:
    """Tracking ids whose captures don't agree on the bytes sent: (tracking_id, captures, least, most)."""
    flows = graph.Flows(*args).df
    sums = flows.groupBy("tracking_id", "node_tid").agg(F.sum(F.col("metric.ab_bytes") + F.col("metric.ba_bytes")).alias("n"))
    return sums.groupBy("tracking_id").agg(F.count(F.lit(1)).alias("captures"), F.min("n").alias("least"), F.max("n").alias("most")).filter("least <> most")


@workflow
def captures(graph: Graph, *args) -> DataFrame:
    """Nodes that a capture with this selection runs on."""
    from loomgraph.operators.flows import CAPTURE_TYPES

    found = graph.V().Has(*args)
    return found.filter(found.fields.string("Type").isin(CAPTURE_TYPES)).Dedup().df.select("id")
