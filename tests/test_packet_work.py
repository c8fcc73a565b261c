"""Decoding reads a packet's bytes a bounded number of times, packets that are cut off give what is there, and flow tables of packets are dealt by size."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import packets
from loomgraph.plans.queries import ORACLES, QUERIES
from loomgraph.sources import star

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("mode", ["L2", "L3"])
def test_each_number_is_read_a_few_times(spark, mode):
    raw = spark.range(1).selectExpr("id as timestamp", "cast(cast(id as string) as binary) as data", "cast(id as int) as link_type")
    plan = packets.rows(raw, mode)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("conv(") <= 30  # thousands when each column was made from the bytes anew


def test_packets_that_are_cut_off(spark):
    whole = bytes.fromhex("020000000001020000000002" + "8100" + "0007" + "0800" + "4500002c000000004006" + "0000" + "0a010203" + "0a0405ff" + "01bb0050" + "0000000100000002" + "5012")
    names = ["link_a", "link_b", "vlan", "network_a", "network_b", "protocol", "transport_a", "transport_b", "flags"]
    raw = spark.createDataFrame([(n, whole[:n]) for n in range(len(whole) + 1)] + [(-1, None)], "index int, data binary").withColumn("link_type", F.lit(1))
    got = {r["index"]: tuple(r[c] for c in names) for r in packets.decoded(raw).select("index", *names).collect()}
    whole_mac, mac = ("02:00:00:00:00:02", "02:00:00:00:00:01"), lambda b: ":".join(f"{b[i : i + 1].hex()}" for i in range(6))
    for n in range(len(whole) + 1):
        there = lambda at: n > at
        ip = lambda at: ".".join(str(x) for x in whole[:n][at : at + 4]) if there(18) else None
        port = lambda at: int.from_bytes(whole[:n][at : at + 2]) if there(at) else None
        tcp = there(27)
        expected = (mac(whole[:n][6:12]), mac(whole[:n][:6]), (7 if there(15) else 0) if there(14) else None, ip(30), ip(34), "TCP" if tcp else None, port(38) if tcp else None, port(40) if tcp else None)
        assert got[n][:8] == expected, n
        assert got[n][8] == ("SYN|ACK" if there(51) else "" if tcp else None), n
    assert got[len(whole)][:2] == whole_mac and got[-1] == ("", "", *[None] * 7)


@pytest.mark.parametrize("name", ["flow_table_of_packets", "flow_table_of_captures"])
def test_more_packets_make_more_tasks_and_the_same_rows(spark, monkeypatch, name):
    monkeypatch.setattr(star, "INPUT", 16 << 10)
    monkeypatch.setattr(star, "SHUFFLED", 16 << 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
    try:
        con = duckdb.connect()
        for t in ("lineitem", "orders", "supplier", "part", "customer", "nation", "region", "events"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        theirs = con.execute(ORACLES[name])
        columns = [d[0] for d in theirs.description]
        rows = QUERIES[name](spark, DIR).withColumn("_task", F.spark_partition_id()).collect()
        assert len({r["_task"] for r in rows}) > 8  # four without
        assert sorted(str(tuple(r[c] for c in columns)) for r in rows) == sorted(str(r) for r in theirs.fetchall())
    finally:
        for key in ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
            spark.conf.unset(key)
