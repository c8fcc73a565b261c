"""Node rules: nodes that an operator of the graph declares, and metadata laid over nodes that a traversal finds.

A create rule is a row with Name, Type and any other metadata; its node's id is made from type and name, so the same
rule always means the same node.  Withdrawing a rule takes away what it made.  The functions give new logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.elements import Nodes
from loomgraph.plans import mutation


def declared(rules: DataFrame, now: int) -> DataFrame:
    """First revisions of the nodes of create rules; of rules for one node, one with the smallest metadata counts."""
    rows = rules.select(mutation.node_id(F.col("Type"), F.col("Name")).alias("id"), F.struct("*").alias("metadata"))
    return mutation.added(rows.groupBy("id").agg(F.min("metadata").alias("metadata")), now, origin="rules")


def create(log: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """The log with the rules' nodes; those that are live already stay as they are."""
    return mutation.insert(log, declared(rules, now))


def withdraw(log: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """The log without the live nodes of the rules."""
    return mutation.delete(log, declared(rules, now).select("id"), now)


def update(found: Nodes, now: int, **fields: Column) -> DataFrame:
    """The log after the fields are set on the nodes found: one revision for each node that changes."""
    return mutation.update(found.graph.nodes, found.df.select("id", mutation.with_fields("metadata", **fields).alias("metadata")), now)


def clear(found: Nodes, now: int, *fields: str) -> DataFrame:
    """The log after the fields are made null on the nodes found."""
    kinds = {name: found.graph.nodes.select(f"metadata.{name}").schema[0].dataType for name in fields}
    return update(found, now, **{name: F.lit(None).cast(kind) for name, kind in kinds.items()})
