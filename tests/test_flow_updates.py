"""Periodic updates of flows: gains add up to the flows, and a stream tells what the batch does."""

import random

from pyspark.sql import functions as F

from loomgraph.streaming import flowtable, flowupdates

PACKET = "flow_key string, direction string, at long, bytes long, flags string, application string"


def packets(seed, n=160):
    rng = random.Random(seed)
    rows, at = [], 1
    for _ in range(n):
        at += rng.choice([1, 700, 5_000, 20_000, 90_000])
        rows.append((f"k{rng.randrange(3)}", rng.choice(["AB", "BA"]), at, rng.randrange(100), rng.choice([None, None, "FIN", "RST"]), rng.choice([None, None, "DNS"])))
    return rows


def test_gains_add_up_to_the_flows(spark):
    df = spark.createDataFrame(packets(1), PACKET)
    told = flowupdates.batch(df, 60, 200_000)
    flows = flowtable.batch(df, 200_000)
    summed = told.groupBy("flow_key", "start").agg(*[F.sum(f"update_{c}").alias(c) for c in flowupdates.COUNTERS], F.max("last").alias("last"))
    pick = ("flow_key", "start", "last", *flowupdates.COUNTERS)
    assert sorted(map(tuple, summed.select(*pick).collect())) == sorted(map(tuple, flows.select(*pick).collect()))
    last = told.groupBy("flow_key", "start").agg(*[F.max_by(c, "update_last").alias(c) for c in flowupdates.COUNTERS])  # the last update has it all
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, flows.select("flow_key", "start", *flowupdates.COUNTERS).collect()))
    assert told.filter("update_start < start or update_last <= last - 60000 or update_ab_packets + update_ba_packets = 0").count() == 0


def test_updates_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = packets(2)
    random.Random(3).shuffle(rows)  # within a file packets come in any order
    df = spark.createDataFrame(rows, PACKET)
    df.repartition(1).write.parquet(str(tmp_path / "in1"))
    spark.createDataFrame([("end", "AB", 10**10, 0, None, None)], PACKET).write.parquet(str(tmp_path / "in2"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    told = flowupdates.stream(source, 60, 200_000, delay="0 seconds")
    told.writeStream.format("memory").queryName("flow_updates").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    expected = sorted(map(tuple, flowupdates.batch(df, 60, 200_000).collect()))
    assert sorted(map(tuple, spark.table("flow_updates").collect())) == expected and len(expected) > 30
