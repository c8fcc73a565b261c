"""Topology ids: what names a node across hosts and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.flowids import tid, uuid5
from loomgraph.operators.paths import stored
from loomgraph.plans.graph import Graph


def topology_ids(graph: Graph) -> DataFrame:
    """Rows (id, tid) of the nodes that have a topology id, as name-based UUIDs.

    A node's TID in the metadata stays.  A host's is named by its Name; a network name space's (by Path) and an
    OVS bridge's or port's (by UUID) by the host that owns the graph element; a fabric node's is its id.  Any other
    node's is named by its ownership parent's, its Name and its Type, from the roots downwards: a level of the
    ownership tree is joined and stored at a time, and a node with several parents takes the smallest TID.
    """
    nodes = graph.V()
    text = lambda k: F.nullif(nodes.fields.string(k), F.lit(""))
    rows = stored(nodes.df.select("id", "host", text("TID").alias("known"), text("Type").alias("type"), text("Name").alias("name"), text("Path").alias("path"), text("UUID").alias("uuid"), text("Probe").alias("probe")))
    hosts = rows.filter("type = 'host'").groupBy("host").agg(F.min(uuid5(F.col("name"))).alias("host_tid"))
    rooted = rows.join(hosts, "host", "left")
    named = (
        F.when(F.col("known").isNotNull(), F.col("known"))
        .when(F.col("type") == "host", uuid5(F.col("name")))
        .when(F.col("type") == "netns", tid(F.col("host_tid"), F.col("path"), F.col("type")))
        .when(F.col("type").isin("ovsbridge", "ovsport"), tid(F.col("host_tid"), F.col("uuid"), F.col("type")))
        .when((F.col("probe") == "fabric") & F.col("type").isNotNull(), F.col("id"))
    )
    out = level = stored(rooted.select("id", named.alias("tid")).filter("tid is not null"))
    open_ = rows.filter("type is not null and name is not null and type not in ('host', 'netns', 'ovsbridge', 'ovsport')").select("id", "name", "type")
    edges = graph.E().Has("RelationType", "ownership").df.select("parent", "child")
    step = 0
    while level.take(1):
        step += 1
        found = level.withColumnRenamed("id", "parent").join(edges, "parent").select(F.col("child").alias("id"), "tid")
        found = found.groupBy("id").agg(F.min("tid").alias("root")).join(open_, "id").join(out.select("id"), "id", "left_anti")
        level = stored(found.select("id", tid(F.col("root"), F.col("name"), F.col("type")).alias("tid")))
        out = out.unionByName(level) if step % 8 else stored(out.unionByName(level))
    return out
