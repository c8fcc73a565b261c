"""Changes to a graph as new revisions.

A table of elements is a log of revisions: an update closes the live row (archived_at) and adds one
with revision + 1; a delete closes it with deleted_at too.  All functions take and give frames.  A
change set is one row for each id; several changes of an id in one set are resolved by the caller or by
``newest``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import edits
from loomgraph.functions.flowids import uuid5
from loomgraph.plans.graph import Graph

_COLUMNS = ["id", "host", "origin", "created_at", "updated_at", "deleted_at", "archived_at", "revision"]


def node_id(*parts: Column) -> Column:
    """A name-based id of its parts."""
    return uuid5(F.concat_ws("/", *parts))


def added(rows: DataFrame, now: int, host: str = "", origin: str = "") -> DataFrame:
    """First revisions of new elements: id, metadata (and parent, child)."""
    more = [c for c in rows.columns if c in ("parent", "child", "metadata")]
    null, at = F.lit(None).cast("bigint"), F.lit(now).cast("bigint")
    return rows.select(
        "id", F.lit(host).alias("host"), F.lit(origin).alias("origin"), at.alias("created_at"), at.alias("updated_at"), null.alias("deleted_at"),
        null.alias("archived_at"), F.lit(1).cast("bigint").alias("revision"), *more)


def insert(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with elements whose id isn't live yet; others are left out (see ``conflicts``)."""
    return log.unionByName(new.join(log.filter("archived_at is null").select("id"), "id", "left_anti").select(*log.columns))


def conflicts(log: DataFrame, new: DataFrame) -> DataFrame:
    """Ids that are live already."""
    return new.join(log.filter("archived_at is null").select("id"), "id", "left_semi").select("id")


def dangling(graph: Graph, edges: DataFrame) -> DataFrame:
    """New edges that lack an end."""
    ids = graph.V().df.select("id")
    known = edges.join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").join(ids.withColumnRenamed("id", "child"), "child", "left_semi")
    return edges.join(known.select("id"), "id", "left_anti")


def update(log: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """New metadata for live elements: rows (id, metadata).  An equal one changes nothing."""
    same = F.to_json(F.struct(F.col("metadata"))).eqNullSafe(F.to_json(F.struct(F.col("_new").alias("metadata"))))
    live = log.filter("archived_at is null").join(changes.select("id", F.col("metadata").alias("_new"), F.lit(True).alias("_hit")), "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & ~same
    at = F.lit(now).cast("bigint")
    row = lambda **new: F.struct(*[new.get(c, F.col(c)).alias(c) for c in log.columns])
    # a changed row becomes two; the join is run once for all of them
    both = F.array(row(archived_at=at), row(metadata=F.col("_new"), updated_at=at, revision=F.col("revision") + 1))
    rows = live.select(F.explode(F.when(hit, both).otherwise(F.array(row()))).alias("_row")).select("_row.*")
    return log.filter("archived_at is not null").unionByName(rows)


def with_fields(metadata: str, **fields: Column) -> Column:
    """A struct of metadata with fields set, added or (None) taken away; a name may be a dotted path into nested structs.

    One call is a transaction: with :func:`update` it makes one revision, and none where nothing changes.
    """
    out = F.col(metadata)
    for name, value in fields.items():
        out = out.dropFields(name) if value is None else out.withField(name, value)
    return out


def edit(log: DataFrame, ids: DataFrame, now: int, *ops: tuple) -> DataFrame:
    """The log after edits (see ``functions.edits``) of the VARIANT metadata of live elements *ids* (column id); values may be Columns of the log.

    All edits of a call are one revision, and none where they change nothing.
    """
    live = log.filter("archived_at is null").join(ids.select("id").distinct(), "id", "left_semi")
    return update(log, edits.applied(live, "metadata", *ops).select("id", "metadata"), now)


def delete(log: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Closes the live rows of *ids* (column id)."""
    at = F.lit(now).cast("bigint")
    live = log.filter("archived_at is null").join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    gone = F.col("_hit").isNotNull()
    live = live.withColumns({"deleted_at": F.when(gone, at).otherwise(F.col("deleted_at")), "archived_at": F.when(gone, at)})
    return log.filter("archived_at is not null").unionByName(live.select(*log.columns))


def delete_nodes(graph: Graph, ids: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Node and edge logs after nodes, and before them their edges, are deleted."""
    edges = graph.edges.filter("archived_at is null")
    ends = ids.select("id").distinct()
    dead = edges.join(ends.withColumnRenamed("id", "parent"), "parent", "left_semi").select("id").unionByName(edges.join(ends.withColumnRenamed("id", "child"), "child", "left_semi").select("id"))
    return delete(graph.nodes, ids, now), delete(graph.edges, dead, now)


def link(pairs: DataFrame, relation: Column) -> DataFrame:
    """New edges for rows (parent, child): id, parent, child, metadata."""
    return pairs.select(node_id(F.col("parent"), F.col("child"), relation).alias("id"), "parent", "child", F.struct(relation.alias("RelationType")).alias("metadata"))


def unlink(graph: Graph, pairs: DataFrame, now: int) -> DataFrame:
    """The edge log without the edges between rows (parent, child), whichever way."""
    edges = graph.edges.filter("archived_at is null")
    both = pairs.select("parent", "child").unionByName(pairs.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
    return delete(graph.edges, edges.join(both, ["parent", "child"], "left_semi").select("id"), now)


def newest(changes: DataFrame) -> DataFrame:
    """Of a set of remote changes, each id's highest revision."""
    best = W.partitionBy("id").orderBy(F.col("revision").desc(), F.col("updated_at").desc())
    return changes.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def merge(log: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote live rows take the place of live rows with a lower revision; the others are ignored."""
    remote = newest(remote).select(*log.columns)
    ours = log.filter("archived_at is null").select("id", F.col("revision").alias("_r"))
    fresh = remote.join(ours, "id", "left").filter("_r is null or revision > _r").drop("_r")
    cut = fresh.select("id", F.col("updated_at").alias("_at"))
    live = log.filter("archived_at is null").join(cut, "id", "left").withColumn("archived_at", F.col("_at"))
    return log.filter("archived_at is not null").unionByName(live.select(*log.columns)).unionByName(fresh.select(*log.columns))


def flush(log: DataFrame, origin: str, now: int) -> DataFrame:
    """Closes all live rows of an origin."""
    at = F.lit(now).cast("bigint")
    mine = F.col("archived_at").isNull() & (F.col("origin") == origin)
    return log.withColumns({"deleted_at": F.when(mine, at).otherwise(F.col("deleted_at")), "archived_at": F.when(mine, at).otherwise(F.col("archived_at"))})


def synced(log: DataFrame, origin: str, current: DataFrame, now: int) -> DataFrame:
    """The log after an origin has told all that it holds: rows *current* (id, revision 1 and up).

    Live rows of the origin that it no longer holds are closed, newer revisions take the place of older ones.
    """
    gone = log.filter((F.col("archived_at").isNull()) & (F.col("origin") == origin)).select("id").join(current.select("id"), "id", "left_anti")
    return merge(delete(log, gone, now), current)
