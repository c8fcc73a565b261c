"""Rules for elements that users create: what a node's and an edge's metadata must have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.fields import Fields

#: Metadata keys that a type of node must have beside Type and Name.
BY_TYPE = {"netns": ["Path"], "ovsport": []}


def _missing(fields: Fields, keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(fields.string(k), F.lit("")) == "" for k in keys], F.lit(False))


def invalid_nodes(nodes: DataFrame, by_type: dict[str, list[str]] = BY_TYPE) -> DataFrame:
    """Rows (id, reason) of nodes that lack a field."""
    fields = Fields.of(nodes)
    reason = F.when(_missing(fields, ["Type", "Name"]), F.lit("Type and Name are needed"))
    for kind, keys in by_type.items():
        if keys:
            reason = reason.when((fields.string("Type") == kind) & _missing(fields, keys), F.lit(f"{kind} needs {', '.join(keys)}"))
    return nodes.select("id", reason.alias("reason")).filter("reason is not null")


def invalid_edges(edges: DataFrame) -> DataFrame:
    fields = Fields.of(edges, roots={"Parent": "parent", "Child": "child"}, lists=False)
    reason = F.when(_missing(fields, ["RelationType", "Parent", "Child"]), F.lit("RelationType, Parent and Child are needed"))
    return edges.select("id", reason.alias("reason")).filter("reason is not null")
