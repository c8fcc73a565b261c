"""Metrics' buckets, flow steps, sockets, next hops, packets and the flow table."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import flowids, timeparse
from loomgraph.operators import linkers, metrics
from loomgraph.operators.flows import COUNTERS
from loomgraph.plans import workflows
from loomgraph.plans.graph import Graph, Slice
from loomgraph.sources import pcap, sinks
from loomgraph.sources.store import Store
from loomgraph.streaming import changes, flowtable
from tests.test_graph import build, ids, n

#: Series of (counter, start, last), a window, and the buckets of ten seconds worked out by hand.
GOLDEN = [
    ([[(900, 0, 30)]], (0, 30), [300] * 3), ([[(7, 0, 40)]], (0, 40), [1, 2, 2, 2]), ([[(500, 4, 24)]], (0, 30), [150, 250, 100]), ([[(500, 4, 24)]], (10, 30), [250, 100]),
    ([[(1, 0, 90)]], (0, 10), [1]), ([[(1, 0, 90)]], (10, 20), [0]), ([[(64, 12, 19)]], (10, 20), [64]), ([[(900, 0, 30)], [(500, 4, 24)]], (0, 30), [450, 550, 400]),
    ([[(80, 0, 8), (40, 8, 16), (20, 16, 40)]], (0, 40), [90, 33, 8, 9]),
]


def points(spark, series):
    rows = [(str(k), *[v] * 4, s * 1000, e * 1000) for k, one in enumerate(series) for v, s, e in one]
    return spark.createDataFrame(rows, "key string, ab_packets long, ab_bytes long, ba_packets long, ba_bytes long, start long, last long")


@pytest.mark.parametrize("series, window, expected", GOLDEN)
def test_aggregates(spark, series, window, expected):
    g = Graph(None, None, slice=Slice(window[0] * 1000, window[1] * 1000, False))
    rows = metrics.Metrics(g, points(spark, series), COUNTERS).Aggregates(10).df.orderBy("start").collect()
    assert [[r[c] for c in COUNTERS] for r in rows] == [[x] * 4 for x in expected]
    assert [r["start"] for r in rows] == [(window[0] + 10 * i) * 1000 for i in range(len(expected))]


def fold(series, first, length, steps):
    """Plain fold of one series of points that don't overlap."""
    out = {}
    for v, s, e in series:
        at = s
        if s < first:
            v -= int(v * (first - s) / (e - s))
            at = first
        whole = v if s >= first else None
        for i in range(max(0, min((at - first) // length, steps - 1)), steps):
            low, cut = first + i * length, first + (i + 1) * length
            part = v if e <= cut else int(v * (cut - at) / (e - at))
            if part == 0 and low <= s < cut:
                out[i] = out.get(i, 0) + whole
                break
            out[i] = out.get(i, 0) + part
            if e <= cut:
                break
            v, at = v - part, cut
    return out


def test_aggregates_like_a_plain_fold(spark):
    rng = random.Random(5)
    series, at = [], 0
    for _ in range(40):
        at += rng.randrange(0, 7)
        end = at + rng.randrange(1, 45)
        series.append((rng.randrange(0, 50), at, end))
        at = end
    last = -(-at // 10) * 10
    g = Graph(None, None, slice=Slice(0, last * 1000, False))
    rows = metrics.Metrics(g, points(spark, [series]), COUNTERS).Aggregates(10).df.collect()
    assert {r["start"] // 10000: r["ab_bytes"] for r in rows} == fold([(v, s * 1000, e * 1000) for v, s, e in series], 0, 10_000, last // 10)


def test_metric_sums(spark):
    g = Graph(None, None)
    m = metrics.Metrics(g, points(spark, [[(18000, 0, 30)], [(5, 40, 50)]]), COUNTERS)
    assert m.Count().first()["count"] == 2 and m.Sum("ABBytes").first()["sum"] == 18005
    assert tuple(m.Sum().first()) == (18005, 18005, 18005, 18005, 0, 50000)


@pytest.fixture(scope="module")
def flows(spark):
    layer = "struct<protocol:string,a:string,b:string,id:long>"
    metric = "struct<ab_packets:long,ab_bytes:long,ba_packets:long,ba_bytes:long,start:long,last:long,rtt:long>"
    schema = f"uuid string, tracking_id string, application string, node_tid string, start long, last long, link {layer}, network {layer}, transport struct<protocol:string,a:long,b:long,id:long>, icmp struct<type:string,code:long,id:long>, metric {metric}"
    rows = [
        (f"u{i}", f"t{i % 2}", "ICMPv4", f"tid{i}", i, 100 - i, ("ETHERNET", "m1", f"m{i}", 0), ("IPV4", "10.0.0.1", f"10.0.0.{i}", 0), ("TCP", 1000, 80, 0), ("ECHO", 0, 222 * i), (i, 10 * i, 0, 0, 0, 1, 0))
        for i in (1, 2, 3)
    ]
    nodes = {"a": {"MAC": "m1", "TID": "tid1", "Type": "host"}, "b": {"PeerIntfMAC": "m2", "Type": "veth", "TID": "tid2"}, "c": {"MAC": "m2", "Type": "x", "TID": "tid3"}}
    g = build(spark, nodes, [("e", "a", "b", {})])
    g.flows = spark.createDataFrame(rows, schema)
    g.sockets = spark.createDataFrame(
        [("a", "p", 1, "client", "10.0.0.1", 1000, "10.0.0.2", 80, "TCP", "E"), ("b", "q", 2, "server", "10.0.0.2", 80, "10.0.0.1", 1000, "TCP", "E"), ("b", "q", 2, "udp", "10.0.0.2", 80, "10.0.0.1", 1000, "UDP", "E")],
        "node_id string, process string, pid long, name string, local_address string, local_port long, remote_address string, remote_port long, protocol string, state string")
    raw = bytes(12) + b"\x08\x00" + bytes([0x45] + [0] * 8 + [6] + [0] * 2 + [10, 0, 0, 1] + [10, 0, 0, 2]) + struct.pack(">HH", 1000, 80)
    g.raw_packets = spark.createDataFrame([("u1", 5, 0, bytearray(raw), 1), ("u2", 6, 0, bytearray(b"\x01"), 1)], "flow_uuid string, timestamp long, index long, data binary, link_type int")
    return g


def names(found):
    return sorted(r["uuid"] for r in found.df.collect())


def test_flow_steps(flows):
    f = flows.Flows()
    assert names(f.Has("ICMP.ID", 222)) == ["u1"] and names(f.HasEither("ICMP.ID", 222, "ICMP.ID", 666)) == ["u1", "u3"]
    assert names(f.Has("Link", "m2")) == ["u2"] and names(f.Has("Network.B", "10.0.0.3", "Application", "ICMPv4")) == ["u3"]
    assert n(f.Dedup()) == 2 and [r["uuid"] for r in f.Sort().Limit(2).df.collect()] == ["u3", "u2"]
    assert f.Sum("Metric.ABBytes").first()["sum"] == 60.0 and "ICMP.ID" in f.Keys()
    assert ids(f.Has("ICMP.ID", 444).Out()) == ["b"] and ids(f.In()) == ["a", "a", "a"] and ids(f.Has("ICMP.ID", 444).Both()) == ["a", "b"]
    assert ids(f.Hops()) == ["a", "b", "c"] and ids(f.Has("ICMP.ID", 444).Nodes()) == ["a", "b", "c"]
    assert f.Group().Count().first()["count"] == 2 and names(f.Group().MoreThan()) == ["u1", "u3"]
    assert names(flows.V().Flows()) == ["u1", "u2"]
    assert f.Metrics().Sum("ABPackets").first()["sum"] == 6
    for bad in (lambda: f.Has("ICMP.ID"), lambda: f.Sum("Start")):
        with pytest.raises(ValueError):
            bad()


def test_sockets_and_packets(flows):
    assert flows.V("b").Sockets().Has("Name", "server").Count().first()["count"] == 1
    assert sorted(r["value"] for r in flows.Flows("UUID", "u2").Sockets().Values("Name").df.collect()) == ["client", "server"]
    p = flows.Flows().RawPackets()
    assert n(p) == 2
    for text, count in (("ip", 1), ("tcp and port 80", 1), ("src port 80", 0), ("dst host 10.0.0.2", 1), ("udp", 0), ("net 10.0.0.0/8 and src port 1000", 1)):
        assert n(p.BPF(text)) == count, text
    matrix = workflows.run(flows, "flow_matrix").collect()
    assert [(r["client"], r["server"], r["port"]) for r in matrix] == [("client", "server", 80)]


def test_capture_files(spark, flows, tmp_path):
    content = pcap.write(flows.raw_packets.coalesce(1)).first()["content"]
    (tmp_path / "a.pcap").write_bytes(content)
    rows = pcap.read(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r["timestamp"], r["link_type"], len(r["data"])) for r in rows] == [(5, 1, 38), (6, 1, 1)]
    assert [r["packets"] for r in pcap.write(flows.raw_packets.coalesce(1), size=40).collect()] == [1, 1]  # another file begins


def test_next_hop(spark):
    tables = [{"Id": 1, "Routes": [
        {"Prefix": "0.0.0.0/0", "NextHops": [{"IP": "10.0.0.254", "IfIndex": 1}]},
        {"Prefix": "192.168.0.0/24", "NextHops": [{"IP": "10.16.0.2", "IfIndex": 2}]},
        {"Prefix": "10.5.0.0/16", "NextHops": [{"IfIndex": 3}]}]}]
    kind = "struct<RoutingTables:array<struct<Id:long,Routes:array<struct<Prefix:string,NextHops:array<struct<IP:string,IfIndex:long>>>>>>,Neighbors:array<struct<IP:string,MAC:string>>>"
    g = build(spark, {"x": {"RoutingTables": tables, "Neighbors": [{"IP": "10.16.0.2", "MAC": "fa"}]}}, [("e", "x", "x", {})])
    g.nodes = g.nodes.withColumn("metadata", F.from_json(F.to_json("metadata"), kind))
    hop = lambda ip: tuple(g.V().NextHop(ip).first())[1:]
    assert hop("192.168.0.9") == ("10.16.0.2", "fa", 2) and hop("10.5.1.1") == ("10.5.1.1", "", 3) and hop("8.8.8.8") == ("10.0.0.254", "", 1)


def test_linkers(spark):
    g = build(spark, {"a": {"PeerIntfMAC": "m", "K": ["x", "y"]}, "b": {"MAC": "m", "K": ["y", "z"]}}, [("e", "a", "c", {})])
    assert [(r["parent"], r["child"]) for r in linkers.peering(g).collect()] == [("a", "b")]
    assert not linkers.are_linked(g, "a", "b") and linkers.are_linked(g, "c", "a")
    assert linkers.edge_rule(g.V("a"), g.V("b"), "r").count() == 1


def test_flow_table_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows, at = [], 0
    for _ in range(200):
        at += rng.randrange(0, 200_000)
        rows.append((str(rng.randrange(4)), rng.choice(["AB", "BA"]), at, rng.randrange(100), None))
    rows.append(("end", "AB", at + 10_000_000, 1, None))
    df = spark.createDataFrame(rows, "flow_key string, direction string, at long, bytes long, flags string")
    for i in range(4):
        df.filter(F.col("at").between(i * at // 4 + (i > 0), (i + 1) * at // 4 if i < 3 else 10**12)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = flowtable.stream(source).writeStream.format("memory").queryName("flows_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    columns = [c.split()[0] for c in flowtable.SCHEMA.split(", ")]
    got = sorted(tuple(r) for r in spark.table("flows_out").select(*columns).collect())
    assert got == sorted(tuple(r) for r in flowtable.batch(df).select(*columns).filter("flow_key <> 'end'").collect())


def test_changes_alerts_and_subscriptions(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, changes.SCHEMA)

    seen, fired = [], []
    sub = changes.Subscription(lambda g: g.V().Has("Type", "host").SubGraph(), lambda d: seen.append(sorted((r["change"], r["id"]) for r in d.collect())))
    alert = changes.Alert("down", lambda g: g.V().Has("State", "DOWN").df.select("id"), lambda name, d: fired.append(d.count()))
    meta = lambda **kw: json.dumps({"Type": "host"} | kw)
    for i, rows in enumerate([
        [("add", "node", "a", None, None, 1, 1, meta()), ("add", "node", "b", None, None, 1, 1, meta())],
        [("update", "node", "a", None, None, 2, 2, meta(State="DOWN"))],
        [("delete", "node", "b", None, None, 3, 2, "{}")],
    ]):
        batch(*rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"x={i}"))
        source = spark.readStream.schema(changes.SCHEMA + ", x int").parquet(str(tmp_path / "in")).drop("x")
        changes.follow(source, str(tmp_path / "log"), str(tmp_path / "c"), sub, alert).awaitTermination()
    assert seen == [[("added", "a"), ("added", "b")], [("removed", "b")]] and fired == [1]
    old = changes.graph_of(spark.read.parquet(str(tmp_path / "log")))
    assert ids(old.V()) == ["a"]


def test_alerts_by_time(spark, flows, tmp_path):
    import time

    fired = []
    alert = changes.Alert("hosts", lambda g: g.V().Has("Type", "host").df.select("id"), lambda name, d: fired.append((name, d.count())))
    running = changes.timed(spark, lambda: flows, str(tmp_path / "c"), alert, every="1 second")
    end = time.time() + 60
    while time.time() < end and len([p for p in running.recentProgress if p["numInputRows"]]) < 3:
        time.sleep(0.5)
    running.stop()
    assert fired == [("hosts", 1)]  # an unchanged result fires once


def test_lives_of_an_element(spark):
    """Deleted and added again, an element begins at revision 1: it is live, with a creation time of its own."""
    rows = [("add", "node", "a", None, None, 100, 1, "{}"), ("update", "node", "a", None, None, 150, 2, "{}"), ("delete", "node", "a", None, None, 200, 3, "{}"), ("add", "node", "a", None, None, 300, 1, "{}"),
            ("add", "node", "b", None, None, 120, 1, "{}"), ("delete", "node", "b", None, None, 310, 2, "{}")]
    log = spark.createDataFrame(rows, changes.SCHEMA)
    got = sorted(tuple(r) for r in changes.revisions(log).select("id", "created_at", "updated_at", "deleted_at", "archived_at").collect())
    assert got == [("a", 100, 100, None, 150), ("a", 100, 150, 200, 200), ("a", 300, 300, None, None), ("b", 120, 120, 310, 310)]
    assert ids(changes.graph_of(log).V()) == ["a"]
    live = None
    for at in range(0, len(rows), 2):  # in any cut, the live rows are those of the whole log
        live = changes.advance(live, spark.createDataFrame(sorted(rows, key=lambda r: r[5])[at : at + 2], changes.SCHEMA))
        whole = changes.revisions(spark.createDataFrame(sorted(rows, key=lambda r: r[5])[: at + 2], changes.SCHEMA)).filter("archived_at is null")
        assert sorted(map(tuple, live.select("id", "at", "created_at", "revision").collect())) == sorted(map(tuple, whole.select("id", "updated_at", "created_at", "revision").collect()))


def test_packet_filters_and_decoding(spark):
    from loomgraph.functions import packets
    from loomgraph.operators.rawpackets import RawPackets

    def frame(source, target, proto, a, b, tag=None, flags=0x12, macs="0200000000aa0200000000bb"):
        body = bytes([0x45, 0, 0, 40, 0, 0, 0, 0, 64, proto, 0, 0]) + bytes(map(int, source.split("."))) + bytes(map(int, target.split("."))) + struct.pack(">HHIIBB", a, b, 0, 0, 0x50, flags)
        vlan = struct.pack(">HH", 0x8100, tag) if tag is not None else b""
        return bytes.fromhex(macs) + vlan + struct.pack(">H", 0x0800) + body

    six = bytes.fromhex("0200000000aa" "0200000000bb" "86dd") + bytes([0x60, 0, 0, 0, 0, 8, 17, 64]) + bytes(15) + b"\1" + bytes(15) + b"\2" + struct.pack(">HHHH", 53, 4000, 8, 0)
    data = [frame("10.0.0.1", "10.0.0.2", 6, 1000, 80), frame("10.0.0.2", "10.0.0.1", 6, 80, 1000, flags=0x11, macs="0200000000bb0200000000aa"), frame("10.0.1.9", "10.0.0.2", 17, 53, 53, tag=7), six]
    raw = spark.createDataFrame([(f"f{i}", i * 10, i, bytearray(x), 1) for i, x in enumerate(data)], "flow_uuid string, timestamp long, index long, data binary, link_type int")
    seen = lambda text: sorted(r["index"] for r in RawPackets(None, raw).BPF(text).df.collect())
    assert seen("tcp") == [0, 1] and seen("udp") == [2, 3] and seen("ip6") == [3] and seen("ip") == [0, 1, 2] and seen("vlan 7") == [2] and seen("vlan") == [2]
    assert seen("tcp or vlan") == [0, 1, 2] and seen("not tcp") == [2, 3] and seen("not (tcp or ip6)") == [2] and seen("port 53 and not vlan") == [3]
    assert seen("src host 10.0.0.1 or dst host 10.0.0.1") == [0, 1] and seen("net 10.0.1.0/24") == [2] and seen("ether src 02:00:00:00:00:bb") == [0, 2, 3] and seen("ether dst 02:00:00:00:00:bb") == [1]
    for wrong in ("tcp and", "(tcp", "tcp)", "port", "frob 1"):
        with pytest.raises(ValueError):
            seen(wrong)
    rows = {r["at"] // 10: r for r in packets.rows(raw, "L3").collect()}
    assert rows[0]["flow_key"] == rows[1]["flow_key"] == "10.0.0.1/10.0.0.2/TCP/1000/80" and (rows[0]["direction"], rows[1]["direction"]) == ("AB", "BA")
    assert rows[0]["flags"] == "SYN|ACK" and rows[1]["flags"] == "FIN|ACK" and rows[3]["network_b"].endswith("02") and rows[3]["transport_a"] == 53
    two = packets.rows(raw, "L2").collect()
    assert len({r["flow_key"] for r in two}) == 3 and all("02:00:00:00:00:aa" in r["flow_key"] for r in two)
    flows = flowtable.batch(packets.rows(raw, "L3")).filter("ab_packets + ba_packets = 2").collect()
    assert [(r["ab_packets"], r["ba_packets"], r["start"], r["last"]) for r in flows] == [(1, 1, 0, 10)]


def test_update_stream_equals_updates(spark, tmp_path):
    rng = random.Random(8)
    rows = spark.createDataFrame([(f"k{rng.randrange(3)}", rng.choice(["AB", "BA"]), rng.randrange(0, 600_000), rng.randrange(100)) for _ in range(300)], "flow_key string, direction string, at long, bytes long")
    rows.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", "AB", 10_000_000, 0)], rows.schema).write.parquet(str(tmp_path / "in2"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    flowtable.update_stream(source, delay="10 minutes").writeStream.format("memory").queryName("gained").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    told = spark.table("gained")
    whole = flowtable.updates(rows).select(*told.columns)
    assert flowtable.subscribed(told.withColumn("capture_id", F.lit("x")), "y").count() == 0
    key = lambda r: tuple(r)
    assert sorted(map(key, told.collect())) == sorted(map(key, whole.collect()))


def test_contexts_of_a_store_prune_days(spark, tmp_path):
    day = 86_400_000
    base = "id string, host string, origin string, created_at long, updated_at long, deleted_at long, archived_at long, revision long, metadata struct<Type:string>"
    rows = [(f"n{i}", "", "", i * day, i * day, None, None, 1, ("host",)) for i in range(6)]
    store = Store(spark, str(tmp_path / "s"))
    store.write("nodes", spark.createDataFrame(rows, base))
    store.write("edges", spark.createDataFrame([(*r[:8], r[8], "n0", r[0]) for r in rows], base + ", parent string, child string"))
    raw = spark.createDataFrame([(f"f{i}", i * day, 0, bytearray(b"x"), 1) for i in range(6)], "flow_uuid string, timestamp long, index long, data binary, link_type int")
    store.write("raw_packets", raw)
    g = store.graph().Context(2 * day + 3_000_000_000)  # ms, as it is larger than seconds can be
    assert ids(store.graph().Context(f"-{4 * 24}h", now_ms=6 * day).V()) == ["n0", "n1", "n2"]
    plan = store.graph().Context(f"-{4 * 24}h", now_ms=6 * day).V().df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and g.prune is not None
    assert sorted(r["flow_uuid"] for r in store.search_raw_packets(day, 3 * day, spark.createDataFrame([("f1",), ("f3",), ("f5",)], "uuid string")).collect()) == ["f1", "f3"]


def test_store_rolls(spark, flows, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    day = 86_400_000
    rows = spark.createDataFrame([(f"f{i}", i * day, i * day + 5) for i in range(4)], "uuid string, start long, last long")
    store.write("flows", rows)
    assert len(store.days("flows")) == 4 and store.search_flows(day, 2 * day + 1).count() == 2
    assert len(store.roll("flows", 2)) == 2 and store.read("flows").count() == 2


def test_store_rolls_by_rows_and_age(spark, tmp_path):
    store, day = Store(spark, str(tmp_path / "s")), 86_400_000
    store.write("flows", spark.createDataFrame([(f"f{i}{j}", i * day, i * day + j) for i in range(5) for j in range(i + 1)], "uuid string, start long, last long"))
    assert store.roll_age("flows", 4 * day, 5 * day) == ["1970-01-01"] and store.read("flows").count() == 14
    assert store.roll_rows("flows", 14) == [] and store.roll_rows("flows", 11) == ["1970-01-02", "1970-01-03"]
    assert store.roll_rows("flows", 1) == ["1970-01-04"] and store.read("flows").count() == 5  # the newest day stays


def test_cached_graph_of_a_store(spark, tmp_path):
    base = "id string, host string, origin string, created_at long, updated_at long, deleted_at long, archived_at long, revision long, metadata struct<Type:string>"
    day = 86_400_000
    rows = [("a", "", "", day, day, None, 3 * day, 1, ("old",)), ("a", "", "", day, 3 * day, None, None, 2, ("new",)), ("b", "", "", day, day, 2 * day, 2 * day, 1, ("gone",))]
    store = Store(spark, str(tmp_path / "s"))
    store.write("nodes", spark.createDataFrame(rows, base))
    store.write("edges", spark.createDataFrame([(*rows[1], "a", "a")], base + ", parent string, child string"))
    g = store.cached_graph()
    assert ids(g.V()) == ["a"] and g.nodes.is_cached and n(g.E()) == 1
    assert ids(g.V().Has("Type", "new")) == ["a"] and ids(g.Context(f"-{24}h", now_ms=int(2.5 * day)).V()) == ["a", "b"]
    g.nodes.unpersist()
    g.edges.unpersist()


def test_sinks_and_helpers(spark, flows):
    text = sinks.dot(flows)
    assert '"a" -> "b"' in text and len(sinks.json_lines(flows.V().df).collect()) == 3
    assert timeparse.duration_ms("-1m30s") == -90_000 and timeparse.instant_ms(5, 0) == 5000 and timeparse.instant_ms(5_000_000_000, 0) == 5_000_000_000
    row = spark.range(1).select(
        flowids.icmp_type(F.lit(8)).alias("a"), flowids.icmp_type(F.lit(200)).alias("b"), flowids.application(F.lit(5), F.lit(53), {53: "dns"}).alias("c"),
        (flowids.tracking_id((F.lit("x"), F.lit("y"))) == flowids.tracking_id((F.lit("y"), F.lit("x")))).alias("d")).first()
    assert tuple(row) == ("ECHO", "UNKNOWN", "DNS", True)


def test_tcp_metrics_and_updates(spark):
    rows = [("k", "AB", 10, 5, "SYN", 64), ("k", "BA", 14, 5, "SYN/ACK", 60), ("k", "AB", 20, 7, "ACK", 64), ("k", "BA", 70_000, 1, "FIN", 60)]
    df = spark.createDataFrame(rows, "flow_key string, direction string, at long, bytes long, flags string, ttl long")
    r = flowtable.tcp_metrics(df).first()
    assert (r["ab_syn_start"], r["ba_syn_start"], r["ab_syn_ttl"], r["ba_fin_start"], r["ab_rst_start"], r["rtt"]) == (10, 14, 64, 70_000, None, 4_000_000)
    got = [tuple(x)[1:] for x in flowtable.updates(df).orderBy("start").collect()]
    assert got == [(0, 2, 12, 1, 5, 60_000), (60_000, 0, 0, 1, 1, 120_000)]
    assert flowtable.batch(df).first()["finish_type"] == flowtable.TIMEOUT


def test_schema_rules(spark):
    from loomgraph.plans import schema

    g = build(spark, {"a": {"Type": "host", "Name": "x"}, "b": {"Type": "netns", "Name": "y"}, "c": {"Name": "z"}}, [("e", "a", "b", {"RelationType": "own"}), ("f", "a", "b", {})])
    assert sorted(r["id"] for r in schema.invalid_nodes(g.nodes).collect()) == ["b", "c"]
    assert [r["id"] for r in schema.invalid_edges(g.edges).collect()] == ["f"]
