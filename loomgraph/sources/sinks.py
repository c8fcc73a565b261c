"""Results as JSON and Graphviz lines: one row of text for each element, written by any text sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.graph import Graph


def json_lines(found: DataFrame) -> DataFrame:
    return found.select(F.to_json(F.struct("*")).alias("value"))


def dot_lines(graph: Graph) -> DataFrame:
    """Lines of a digraph's body: nodes with name and type, then edges with their relation."""
    nodes, edges = graph.V(), graph.E()
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))
    label = F.concat_ws("\\n", nodes.fields.string("Name"), nodes.fields.string("Type"))
    of_nodes = nodes.df.select(F.concat(quote(F.col("id")), F.lit(" [label="), quote(label), F.lit("]")).alias("value"))
    relation = F.coalesce(edges.fields.string("RelationType"), F.lit(""))
    of_edges = edges.df.select(F.concat(quote(F.col("parent")), F.lit(" -> "), quote(F.col("child")), F.lit(" [label="), quote(relation), F.lit("]")).alias("value"))
    return of_nodes.unionByName(of_edges)


def dot(graph: Graph, most: int = 10_000) -> str:
    """A whole digraph as text, for graphs of at most *most* elements."""
    lines = [r["value"] for r in dot_lines(graph).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} elements; write dot_lines() instead")
    return "digraph g {\n" + "\n".join(lines) + "\n}\n"
