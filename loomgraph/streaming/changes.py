"""Graph events, subscriptions and alerts over a stream of element changes.

A change row has op (``add``, ``update``, ``delete``), kind (``node``, ``edge``), id, parent, child, at
(ms), revision and metadata (JSON text), and may have seq, its place in the log.  ``foreachBatch`` hands each
micro-batch to batch code; the state that must outlive a restart is a table beside the log, not the process.

Changes are in order of their time, then seq; without one, changes of an element in the same millisecond are in the only order that
they can have had: of an element that was there, its deletion comes before its addition, of one that wasn't, after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.paths import stored
from loomgraph.plans.graph import Graph
from loomgraph.sources.store import Store

#: Columns of a change.
SCHEMA = "op string, kind string, id string, parent string, child string, at long, revision long, metadata string"


def _ordered(changes: DataFrame) -> DataFrame:
    """Adds _place: the order of an element's changes of one time."""
    if "seq" in changes.columns:
        return changes.withColumn("_place", F.col("seq").cast("double"))
    if "created_at" not in changes.columns:
        changes = changes.withColumn("created_at", F.lit(None).cast("long"))
    element, now = W.partitionBy("kind", "id"), W.partitionBy("kind", "id", "at")
    sign = F.when(F.col("op") == "add", 1).when(F.col("op") == "delete", -1).when(F.col("created_at").isNotNull(), 1).otherwise(0)  # a live row from before counts as added
    before = F.coalesce(F.sum(sign).over(element.orderBy("at").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = F.coalesce(F.max(F.col("created_at").isNotNull().cast("int")).over(now), F.lit(0)) == 1  # the live row itself is of this time
    rank = F.row_number().over(W.partitionBy("kind", "id", "at", "op").orderBy("revision"))
    first_delete = F.min(F.when(F.col("op") == "delete", F.col("revision"))).over(now)
    there = (before > 0) | kept
    place = (
        F.when(F.col("created_at").isNotNull(), -1.0)
        .when(F.col("op") == "add", 2.0 * rank + F.when(there, 1).otherwise(-1)).when(F.col("op") == "delete", 2.0 * rank)
        .when(there & (F.coalesce(first_delete, F.col("revision")) >= F.col("revision")), 1.0).when(there | first_delete.isNull(), 1e9).otherwise(1.5))
    return changes.withColumn("_place", place)


def revisions(changes: DataFrame) -> DataFrame:
    """Revision log of a whole set of changes: each row is closed by the next change of its element.

    An element that is deleted and added again begins at revision 1 anew.  Deletes so far number its lives, and each life has a
    creation time of its own.  Rows of advance()'s result may be among the changes: what was live before.
    """
    order = W.partitionBy("kind", "id").orderBy("at", "_place", "revision")
    deletes = F.coalesce(F.count_if(F.col("op") == "delete").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = _ordered(changes)
    born = F.coalesce(F.col("created_at"), F.col("at")) if "created_at" in rows.columns else F.col("at")
    rows = rows.withColumns({"_next": F.lead("at").over(order), "_op": F.lead("op").over(order), "_life": deletes})
    rows = rows.withColumn("created_at", F.min(born).over(W.partitionBy("kind", "id", "_life")))
    gone = F.col("_op") == "delete"
    return rows.filter("op <> 'delete'").select(
        "kind", "id", "parent", "child", F.lit("").alias("host"), F.lit("").alias("origin"), "created_at", F.col("at").alias("updated_at"),
        F.when(gone, F.col("_next")).alias("deleted_at"), F.col("_next").alias("archived_at"), "revision", F.parse_json("metadata").alias("metadata"))


def graph_of(changes: DataFrame) -> Graph:
    log = revisions(changes)
    return Graph(log.filter("kind = 'node'").drop("kind", "parent", "child"), log.filter("kind = 'edge'").drop("kind"))


@dataclass
class Subscription:
    """Calls *send* with (change, kind, id) rows whenever the sub-graph of *select* changes.

    What it compares with is stored under *state* by epoch, so that a restart sends nothing twice; without *state* it is kept by the process.
    """

    select: Callable[[Graph], Graph]
    send: Callable[[DataFrame], None]
    before: DataFrame | None = None
    state: str | None = None

    def check(self, graph: Graph, epoch: int | None = None) -> None:
        spark, keep = graph.nodes.sparkSession, self.state is not None and epoch is not None
        if keep and epoch in _epochs(spark, f"{self.state}/sent"):
            return  # a micro-batch that runs again after it was told
        if keep:
            last = max((e for e in _epochs(spark, self.state) if e < epoch), default=None)
            self.before = None if last is None else spark.read.parquet(f"{self.state}/epoch={last}")
            self.select(graph).Elements().write.mode("overwrite").parquet(f"{self.state}/epoch={epoch}")
            now = spark.read.parquet(f"{self.state}/epoch={epoch}")
        else:
            now = stored(self.select(graph).Elements())  # what the next check compares with must not change meanwhile
        changed = now if self.before is None else now.join(self.before, ["kind", "id"], "left_anti")
        changed = changed.withColumn("change", F.lit("added"))
        if self.before is not None:
            changed = changed.unionByName(self.before.join(now, ["kind", "id"], "left_anti").withColumn("change", F.lit("removed")))
        if changed.take(1):
            self.send(changed)
        self.before = now
        if keep:
            _done(spark, self.state, epoch)


@dataclass
class Alert:
    """Fires when the result of *expression* isn't empty and differs from the last one, which is stored under *state* by epoch if it is given."""

    name: str
    expression: Callable[[Graph], DataFrame]
    fire: Callable[[str, DataFrame], None]
    last: tuple | None = field(default=None)
    state: str | None = None

    def check(self, graph: Graph, epoch: int | None = None) -> bool:
        spark, keep = graph.nodes.sparkSession, self.state is not None and epoch is not None
        if keep:
            if epoch in _epochs(spark, f"{self.state}/sent"):
                return False
            last = max((e for e in _epochs(spark, self.state) if e < epoch), default=None)
            self.last = None if last is None else tuple(spark.read.parquet(f"{self.state}/epoch={last}").first())
        found = self.expression(graph)
        text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        summed = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.lit(0)).alias("sum"))
        if keep:
            summed.write.mode("overwrite").parquet(f"{self.state}/epoch={epoch}")
            summed = spark.read.parquet(f"{self.state}/epoch={epoch}")
        state = tuple(summed.first())
        new = state[0] > 0 and state != self.last
        self.last = state
        if new:
            self.fire(self.name, found)
        if keep:
            _done(spark, self.state, epoch)
        return new


def _done(spark: SparkSession, state: str, epoch: int) -> None:
    """Marks an epoch as told, and deletes what only earlier ones need."""
    path, files = _path(spark, f"{state}/sent/epoch={epoch}/_SUCCESS")
    files.create(path, True).close()
    for folder in (state, f"{state}/sent"):
        for old in _epochs(spark, folder):
            if old < epoch:
                where, files = _path(spark, f"{folder}/epoch={old}")
                files.delete(where, True)


def advance(live: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The live rows after a set of changes, from the live rows before it: (kind, SCHEMA's columns, created_at)."""
    rows = changes.withColumn("created_at", F.lit(None).cast("long"))
    if live is not None:
        rows = rows.unionByName(live, allowMissingColumns=True)
    order = W.partitionBy("kind", "id").orderBy("at", "_place", "revision")
    rows = _ordered(rows)
    deletes = F.coalesce(F.count_if(F.col("op") == "delete").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_last": F.lead("op").over(order).isNull(), "_life": deletes})
    rows = rows.withColumn("created_at", F.min(F.coalesce("created_at", "at")).over(W.partitionBy("kind", "id", "_life")))
    return rows.filter("_last and op <> 'delete'").drop("_last", "_life", "_place", "seq")


def put(store: Store, changes: DataFrame, token: str | None = None) -> None:
    """Takes a set of changes into a store's nodes and edges: only the buckets of their ids are read and written."""
    changes = stored(changes)
    for table, kind in (("nodes", "node"), ("edges", "edge")):
        history = store.history(table)
        mine = changes.filter(F.col("kind") == kind)
        if history.exists() and not mine.take(1):
            continue
        if not history.exists():
            log = revisions(mine)
        else:
            live = history.live().join(mine.select("id").distinct(), "id", "left_semi")
            ends = ("parent", "child") if kind == "edge" else ()
            rows = live.select(
                F.lit("update").alias("op"), F.lit(kind).alias("kind"), "id", *[F.col(c) if c in ends else F.lit(None).cast("string").alias(c) for c in ("parent", "child")],
                F.col("updated_at").alias("at"), "revision", F.to_json("metadata").alias("metadata"), "created_at")
            rows = rows.withColumn("seq", F.lit(-1).cast("long")) if "seq" in mine.columns else rows
            log = revisions(mine.withColumn("created_at", F.lit(None).cast("long")).unionByName(rows))
        # what was added and deleted within one millisecond was never seen, and would have the name of what was added then
        log = log.filter("deleted_at is null or deleted_at > created_at")
        history.put(log.drop("kind", *(() if kind == "edge" else ("parent", "child"))), token)


def follow(stream: DataFrame, log_path: str, checkpoint: str, *watchers: Subscription | Alert, once: bool = True):
    """Appends the stream's changes to the log and lets the watchers see the live graph after each micro-batch.

    The graph is a store beside the log, whose buckets of changed ids alone are written anew: a batch's work grows neither with the log nor
    with the graph.  A batch that runs again finds its epoch stored and changes nothing.  Watchers keep their state beside the
    log too.  For the past, take a ``Context`` of the store's graph, or read the log with :func:`graph_of`.
    """
    live = f"{log_path.rstrip('/')}-live"
    for n, watcher in enumerate(watchers):
        watcher.state = watcher.state or f"{log_path.rstrip('/')}-watchers/{getattr(watcher, 'name', 'subscription')}-{n}"

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # a batch that runs again overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{log_path}/epoch={epoch}")
        store = Store(spark, live)
        put(store, spark.read.parquet(f"{log_path}/epoch={epoch}"), f"epoch-{epoch}")
        for watcher in watchers:
            watcher.check(store.graph()._with(history=False), epoch)
        for table in ("nodes", "edges"):
            store.history(table).vacuum(keep=2)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def timed(spark: SparkSession, graph: Callable[[], Graph], checkpoint: str, *alerts: Alert, every: str = "10 seconds"):
    """Checks the alerts on a newly read graph every so often, whether or not elements change: results may depend on the time."""
    for n, alert in enumerate(alerts):
        alert.state = alert.state or f"{checkpoint.rstrip('/')}-alerts/{alert.name}-{n}"

    def step(batch: DataFrame, epoch: int) -> None:
        for alert in alerts:
            alert.check(graph(), epoch)

    ticks = spark.readStream.format("rate").option("numPartitions", 1).load()
    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def _path(spark, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _epochs(spark, folder: str) -> list[int]:
    """Epochs that have a folder with a finished table."""
    path, files = _path(spark, folder)
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    found = [int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=")]
    return sorted(e for e in found if files.exists(_path(spark, f"{folder}/epoch={e}/_SUCCESS")[0]))
