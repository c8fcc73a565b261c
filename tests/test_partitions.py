"""Shuffles that are dealt by the size of the tables, and updates that join once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.plans import mutation
from loomgraph.plans.queries import ORACLES, QUERIES
from loomgraph.sources import star

DIR = "/root/testdata/sf0.01"


@pytest.fixture
def small_parts(spark, monkeypatch):
    monkeypatch.setattr(star, "INPUT", 16 << 10)
    monkeypatch.setattr(star, "SHUFFLED", 16 << 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
    yield
    for key in ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        spark.conf.unset(key)


@pytest.mark.parametrize("name,tables", [("tcp_segments", ["lineitem"]), ("changes_revisions", ["orders"])])
def test_more_input_makes_more_tasks_and_the_same_rows(spark, small_parts, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    theirs = con.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    ours = QUERIES[name](spark, DIR)
    rows = ours.withColumn("_task", F.spark_partition_id()).collect()
    assert len({r["_task"] for r in rows}) > 8  # four without
    assert sorted(str(tuple(r[c] for c in columns)) for r in rows) == sorted(str(r) for r in theirs.fetchall())

def test_an_update_joins_once(spark):
    log = mutation.added(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, x int").select("id", F.struct("x").alias("metadata")), 5)
    changes = spark.createDataFrame([("a", 1), ("b", 7)], "id string, x int").select("id", F.struct("x").alias("metadata"))
    out = mutation.update(log, changes, 9)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    assert sorted(map(tuple, out.select("id", "revision", "updated_at", "archived_at", "metadata.x").collect()), key=str) == [
        ("a", 1, 5, None, 1), ("b", 1, 5, 9, 2), ("b", 2, 9, None, 7), ("c", 1, 5, None, 3)]
