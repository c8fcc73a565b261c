"""Edges from metadata: linkers, hardware-address peering and edge rules."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.flowids import uuid5

if TYPE_CHECKING:
    from loomgraph.operators.elements import Nodes
    from loomgraph.plans.graph import Graph


def edge_id(parent: Column, child: Column, kind: Column) -> Column:
    """A name-based id of an edge, the same in every run."""
    return uuid5(F.concat_ws("/", parent, child, kind))


def index(nodes: "Nodes", *keys: str) -> DataFrame:
    """Rows (id, k0, k1 ...): a node with lists has a row for each combination; nodes that lack a key have none."""
    out = nodes.df
    for i, key in enumerate(keys):
        found = nodes.fields.find(key)
        if found is None:
            return nodes.df.limit(0).select("id", *[F.lit("").alias(f"k{j}") for j in range(len(keys))])
        column, kind = found
        out = out.withColumn(f"k{i}", F.explode(column.cast("array<string>")) if isinstance(kind, T.ArrayType) else column.cast("string"))
    return out.select("id", *[f"k{i}" for i in range(len(keys))]).dropna()


def link(left: DataFrame, right: DataFrame, relation: str) -> DataFrame:
    """Edges (id, parent, child, relation) between nodes of two indexes with equal keys; no node is linked with itself."""
    keys = [c for c in left.columns if c != "id"]
    pairs = left.withColumnRenamed("id", "parent").join(right.withColumnRenamed("id", "child"), keys).filter("parent <> child").select("parent", "child").distinct()
    return pairs.select(edge_id(F.col("parent"), F.col("child"), F.lit(relation)).alias("id"), "parent", "child", F.lit(relation).alias("relation"))


def peering(graph: "Graph") -> DataFrame:
    """layer2 edges between a node's PeerIntfMAC and the node with that MAC."""
    return link(index(graph.V(), "PeerIntfMAC"), index(graph.V(), "MAC"), "layer2")


def are_linked(graph: "Graph", parent: str, child: str, *args: Any) -> bool:
    """Whether an edge joins the nodes, whichever way."""
    ends = (F.col("parent") == parent) & (F.col("child") == child) | (F.col("parent") == child) & (F.col("child") == parent)
    return bool(graph.E()._maybe(args).filter(ends).df.take(1))


def first_links(graph: "Graph", pairs: DataFrame, *args: Any) -> DataFrame:
    """For rows (parent, child), the edge with the smallest id that joins them, whichever way: (parent, child, id)."""
    edges = graph.E()._maybe(args).df.select("id", F.least("parent", "child").alias("_a"), F.greatest("parent", "child").alias("_b"))
    keyed = pairs.select("parent", "child", F.least("parent", "child").alias("_a"), F.greatest("parent", "child").alias("_b")).distinct()
    return keyed.join(edges, ["_a", "_b"]).groupBy("parent", "child").agg(F.min("id").alias("id"))


def edge_rule(source: "Nodes", target: "Nodes", relation: str) -> DataFrame:
    """An edge from the first source to the first target, unless they are linked: one row at most."""
    graph = source.graph
    first = source.df.agg(F.min("id").alias("parent")).join(target.df.agg(F.min("id").alias("child")), F.lit(True)).filter("parent is not null and child is not null")
    edges = graph.E().df.select("parent", "child")
    both = edges.unionByName(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
    out = first.join(both, ["parent", "child"], "left_anti")
    return out.select(edge_id(F.col("parent"), F.col("child"), F.lit(relation)).alias("id"), "parent", "child", F.lit(relation).alias("relation"))
