"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges are kept as (v, u) with u < v.  A large-star step links every v to the smallest node that its
neighbour u knows; a small-star step links a node and its smaller neighbours to the smallest of them.
Smallest neighbours are found by aggregations with partial sums, written and joined back, so that a node
with very many neighbours is not gathered in one task: adaptive execution can split its join.  The edge
table is written to the shared folder after each round, so lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) of all nodes that are not their component's smallest node; needs integer ids."""
    now = shared.written(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u <> v").distinct(), "edges")
    size = None
    while True:
        low = shared.written(now.groupBy("v").agg(F.min("u").alias("m")), "edges-low")
        large = now.join(low.withColumnRenamed("v", "u"), "u", "left").select("v", F.coalesce("m", "u").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).distinct()
        new = shared.written(small, "edges")
        state = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0))).first()
        shared.dropped(now)
        shared.dropped(low)
        now = new
        if state == size:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        size = state
