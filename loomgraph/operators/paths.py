"""Reachability and shortest paths by frontier joins.

A round joins the nodes reached last with the edges and drops those reached before.  The reached ids
are stored after every round with checkpoint(), which cuts the lineage and survives lost executors;
a round's work is the frontier's edges, not the graph's.  Cycles end by themselves.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import predicates
from loomgraph.functions.fields import Fields

if TYPE_CHECKING:
    from loomgraph.operators.elements import Nodes
    from loomgraph.plans.graph import Graph

#: Filter of the edges of Descendants and Ascendants if none is given.
OWNERSHIP = ("RelationType", "ownership")


def stored(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder, spark.checkpoint.dir; only a session on one machine may leave it unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = folder or "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def _depth(args: tuple, default: int) -> tuple[tuple, int]:
    if len(args) % 2:
        return args[:-1], int(args[-1])
    return args, default


def _edges(graph: "Graph", condition: Column | None, down: bool, up: bool) -> DataFrame:
    edges = graph.E().df
    if condition is not None:
        edges = edges.filter(condition)
    way = []
    if down:
        way.append(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")))
    if up:
        way.append(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")))
    return way[0] if len(way) == 1 else way[0].unionByName(way[1])


def _expand(start: DataFrame, edges: DataFrame, depth: int | None) -> DataFrame:
    """Ids within *depth* steps (None: all) of the ids in *start*."""
    reached = stored(start.select("id").distinct())
    frontier, step = reached, 0
    while depth is None or step < depth:
        step += 1
        found = frontier.join(edges, frontier["id"] == edges["a"]).select(F.col("b").alias("id")).distinct().join(reached, "id", "left_anti")
        frontier = stored(found)
        if not frontier.take(1):
            break
        reached = reached.unionByName(frontier) if step % 8 else stored(reached.unionByName(frontier))
    return reached


def _nodes(graph: "Graph", ids: DataFrame) -> "Nodes":
    from loomgraph.operators.elements import Nodes

    return Nodes(graph, graph.V().df.join(ids, "id", "left_semi"))


def reach(nodes: "Nodes", args: tuple, down: bool) -> "Nodes":
    """The nodes and what they reach along edges from parent to child (or back); depth 1 by default, 0 is without limit."""
    args, depth = _depth(args, 1)
    graph = nodes.graph
    condition = predicates.has_either(graph.E().fields, args or OWNERSHIP)
    return _nodes(graph, _expand(nodes.df, _edges(graph, condition, down, not down), depth or None))


def neighbors(nodes: "Nodes", args: tuple) -> "Nodes":
    """The nodes and those within *depth* edges in either direction; depth 1 by default, 0 is the nodes alone."""
    args, depth = _depth(args, 1)
    graph = nodes.graph
    condition = predicates.has_either(graph.E().fields, args) if args else None
    return _nodes(graph, _expand(nodes.df, _edges(graph, condition, True, True), depth))


@dataclass
class Paths:
    """Rows (path_id, step, id): step 0 is the start."""

    graph: "Graph"
    df: DataFrame

    def Count(self) -> DataFrame:
        return self.df.agg(F.count_distinct("path_id").alias("count"))

    def Dedup(self) -> "Nodes":
        """The nodes of all paths, once each."""
        return _nodes(self.graph, self.df.select("id").distinct())

    def SubGraph(self) -> "Graph":
        return self.Dedup().SubGraph()

    def Flows(self, *args: Any):
        return self.Dedup().Flows(*args)


def shortest(nodes: "Nodes", target: dict, edge: dict) -> Paths:
    """For every node that reaches the target, a path of the fewest edges, whichever way they point.

    The target is the matching node with the smallest id.  A breadth-first search from the target keeps
    each node's path, over the smallest of equal neighbours; a level is stored once, and only the last one
    is joined with the edges.
    """
    graph = nodes.graph
    seen = graph.V()
    condition = predicates.has(seen.fields, tuple(x for kv in target.items() for x in kv))
    goal = seen.df.filter(condition).agg(F.min("id").alias("id")).filter("id is not null")
    on = predicates.has(Fields.of(graph.E().df, roots={"Parent": "parent", "Child": "child"}, lists=False), tuple(x for kv in edge.items() for x in kv)) if edge else None
    edges = _edges(graph, on, True, True)
    starts = stored(nodes.df.select("id").withColumn("path_id", F.monotonically_increasing_id()))
    frontier = stored(goal.select("id", F.array("id").alias("path")))
    reached, left, step = frontier, starts.select("id").distinct(), 0
    while frontier.take(1):
        left = stored(left.join(frontier, "id", "left_anti"))
        if not left.take(1):  # every start is reached
            break
        step += 1
        found = frontier.join(edges, frontier["id"] == edges["a"]).select(F.col("b").alias("id"), F.col("a").alias("next"), "path")
        found = found.groupBy("id").agg(F.min_by("path", "next").alias("path")).join(reached.select("id"), "id", "left_anti")
        frontier = stored(found.select("id", F.concat(F.array("id"), "path").alias("path")))
        reached = reached.unionByName(frontier) if step % 8 else stored(reached.unionByName(frontier))
    walk = starts.join(reached, "id").select("path_id", F.posexplode("path").alias("step", "id"))
    return Paths(graph, walk)
