"""Incremental linkers against the batch linker after every micro-batch."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import linkers
from loomgraph.streaming import indexer

SCHEMA = "op string, id string, at long, revision long, macs array<string>, peer string"


def rows(seed):
    rng = random.Random(seed)
    alive, out = {}, []
    for at in range(1, 61):
        id = f"n{rng.randrange(8)}"
        macs = [f"m{rng.randrange(5)}" for _ in range(rng.randrange(3))]
        peer = rng.choice([None, f"m{rng.randrange(5)}"])
        if id in alive and rng.random() < 0.25:
            del alive[id]
            out.append(("delete", id, at, 9, None, None))
        else:
            out.append(("update" if id in alive else "add", id, at, 1, macs, peer))
            alive[id] = True
    return out


def test_edges_after_every_micro_batch_are_those_of_the_batch(spark, tmp_path):
    changes, seen = rows(5), []
    for i in range(4):
        part = spark.createDataFrame(changes[15 * i : 15 * i + 15], SCHEMA)
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"x={i}"))
        source = spark.readStream.schema(SCHEMA + ", x int").parquet(str(tmp_path / "in")).drop("x")
        left = F.when(F.col("peer").isNotNull(), F.array(indexer.key_of(F.col("peer"))))
        right = F.transform("macs", lambda m: indexer.key_of(m))
        told = indexer.linked(source, left, right)
        told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        last = {}
        for r in changes[: 15 * i + 15]:
            last[r[1]] = r
        now = spark.createDataFrame([r for r in last.values() if r[0] != "delete"], SCHEMA)
        lefts = now.filter("peer is not null").select("id", F.col("peer").alias("k0"))
        rights = now.select("id", F.explode("macs").alias("k0"))
        expected = sorted((r["parent"], r["child"]) for r in linkers.link(lefts, rights, "layer2").collect())
        log = spark.read.schema(indexer.EDGES).parquet(str(tmp_path / "out"))
        assert sorted((r["parent"], r["child"]) for r in indexer.live(log).collect()) == expected
        seen.append(len(expected))
    assert max(seen) > 2 and len(set(seen)) > 1


def test_actions_wait_for_their_key(spark, tmp_path):
    schema = "key string, side string, id string, gained boolean"
    steps = [[("k", "action", "a1", True)], [("k", "right", "n9", True)], [("k", "left", "n2", True)], [("k", "action", "a2", True)], [("k", "left", "n2", False)], [("k", "action", "a3", True)]]
    for i, step in enumerate(steps):
        spark.createDataFrame(step, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    indexer.edges(source).writeStream.format("memory").queryName("acted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.table("acted").collect())
    assert got == [("act", "k", "a1", "n2"), ("act", "k", "a2", "n2"), ("add", "k", "n2", "n9"), ("delete", "k", "n2", "n9")]


def test_keys(spark):
    row = spark.range(1).select(indexer.key_of(F.lit("a"), F.lit(1)).alias("x"), indexer.key_of(F.lit("a,1")).alias("y"), indexer.key_of(F.lit("a"), F.lit(None).cast("string")).alias("z")).first()
    assert row["x"] != row["y"] and row["z"] is None
