"""Flows that begin with FIN or RST, round trips and capture limits, against plain Python."""

import random

from pyspark.sql import functions as F

from loomgraph.functions import packets
from loomgraph.operators import rawpackets
from loomgraph.streaming import flowtable


def plain(rows):
    """One packet after another: a flow has its finish from its first packet, and with it the time it waits."""
    out = []
    for key in {r[0] for r in rows}:
        flow = None
        for _, way, at, size, flags in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[4] is not None, r[4] or "")):
            if flow is None or (at - flow[2] > 600_000 if flow[7] == "TIMEOUT" else at - flow[2] >= 15_000):
                finish = "TCP_RST" if flags and "RST" in flags else "TCP_FIN" if flags and "FIN" in flags else "TIMEOUT"
                flow = [key, at, at, 0, 0, 0, 0, finish]
                out.append(flow)
            flow[2] = at
            n = 3 if way == "AB" else 5
            flow[n], flow[n + 1] = flow[n] + 1, flow[n + 1] + size
    return sorted(map(tuple, out))


def test_flows_are_held_after_fin_and_rst(spark, tmp_path):
    rng = random.Random(11)
    rows, at = [], 0
    for _ in range(400):
        at += rng.choice([0, 100, 7_000, 15_000, 15_001, 40_000, 300_000])
        rows.append((f"k{rng.randrange(3)}", rng.choice(["AB", "BA"]), at, rng.randrange(100), rng.choice([None, "ACK", "FIN|ACK", "FIN|ACK", "RST", "RST"])))
    df = spark.createDataFrame([*rows, ("end", "AB", at + 10_000_000, 1, None)], "flow_key string, direction string, at long, bytes long, flags string")
    expected = plain(rows)
    assert len({r[7] for r in expected}) == 3 and len(expected) < len(rows)
    columns = [c.split()[0] for c in flowtable.SCHEMA.split(", ")]
    assert sorted(tuple(r) for r in flowtable.batch(df).select(*columns).filter("flow_key <> 'end'").collect()) == expected
    for i in range(4):
        df.filter(F.col("at").between(i * at // 4 + (i > 0), (i + 1) * at // 4 if i < 3 else 10**12)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flowtable.stream(source).writeStream.format("memory").queryName("held_flows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("held_flows").select(*columns).collect()) == expected


def test_round_trips(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(4)}", 10 * i + rng.randrange(10), rng.choice(["ICMP", "ICMP6", "TCP", None]), rng.choice([0, 8, 128, 129, 3, None]), rng.choice(["SYN", "SYN|ACK", "RST", "ACK", None])) for i in range(300)]
    expected = []
    for key in {r[0] for r in rows}:
        asked = None
        for _, at, protocol, kind, flags in (r for r in rows if r[0] == key):
            answer = (protocol, kind) in (("ICMP", 0), ("ICMP6", 129)) or flags in ("SYN|ACK", "RST")
            if answer and asked is not None:
                expected.append((key, asked, at, at - asked))
            if answer:
                asked = None
            elif asked is None and ((protocol, kind) in (("ICMP", 8), ("ICMP6", 128)) or flags == "SYN"):
                asked = at
    df = spark.createDataFrame(rows, "flow_key string, at_ns long, protocol string, icmp_type int, flags string")
    assert sorted(tuple(r) for r in flowtable.round_trips(df).collect()) == sorted(expected) and expected
    assert flowtable.round_trips(df.limit(0)).count() == 0


def test_pings_of_raw_packets(spark):
    def ping(kind, source, target):
        ip = bytes([0x45, 0, 0, 28, 0, 0, 0, 0, 64, 1, 0, 0]) + bytes(source) + bytes(target)
        return bytearray(bytes(12) + b"\x08\x00" + ip + bytes([kind, 0, 0, 0, 0x12, 0x34, 0, 1]))

    raw = spark.createDataFrame([("f", 5, 0, ping(8, (10, 0, 0, 1), (10, 0, 0, 2)), 1), ("f", 9, 1, ping(0, (10, 0, 0, 2), (10, 0, 0, 1)), 1)], "flow_uuid string, timestamp long, index long, data binary, link_type int")
    assert [(r["icmp_type"], r["icmp_id"]) for r in packets.decoded(raw).orderBy("index").collect()] == [(8, 0x1234), (0, 0x1234)]
    assert [(r["asked"], r["rtt"]) for r in flowtable.round_trips(packets.rows(raw, "L3")).collect()] == [(5_000_000, 4_000_000)]


def test_captured_packets(spark):
    rng = random.Random(4)
    rows = [(f"f{rng.randrange(3)}", rng.randrange(50), i) for i in range(90)] + [(None, 1, 0)]
    got = sorted((str(r["flow_uuid"]), r["index"], r["timestamp"]) for r in rawpackets.captured(spark.createDataFrame(rows, "flow_uuid string, timestamp long, index long"), 7).collect())
    expected = []
    for key in {r[0] for r in rows}:
        expected += [(str(key), n + 1, r[1]) for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])[:7])]
    assert got == sorted(expected)
