"""Nested headers, tunnels, fragments and segments against plain Python."""

import random
import struct

import pytest

from loomgraph.functions import layers
from loomgraph.streaming import flowtable, fragments, segments, tunnels


def eth(kind, a=1, b=2):
    return bytes([2, 0, 0, 0, 0, b, 2, 0, 0, 0, 0, a]) + struct.pack(">H", kind)


def ip4(protocol, a, b, payload=b"", ip_id=0, bits=0, open_=False):
    return struct.pack(">BBHHHBBH", 0x45, 0, 0 if open_ else 20 + len(payload), ip_id, bits, 64, protocol, 0) + bytes(map(int, a.split("."))) + bytes(map(int, b.split("."))) + payload


def ip6(protocol, payload):
    return struct.pack(">IHBB", 6 << 28, len(payload), protocol, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + payload


def udp(a, b, payload=b""):
    return struct.pack(">HHHH", a, b, 8 + len(payload), 0) + payload


def tcp(a, b, seq=0, flags=16, payload=b""):
    return struct.pack(">HHIIBBHHH", a, b, seq, 0, 0x50, flags, 0, 0, 0) + payload


def vxlan(vni, payload):
    return b"\x08\0\0\0" + struct.pack(">I", vni << 8) + payload


def gre(kind, payload, key=None):
    return struct.pack(">HH", 0x2000 if key is not None else 0, kind) + (struct.pack(">I", key) if key is not None else b"") + payload


def mpls(label, payload, bottom=True):
    return struct.pack(">I", label << 12 | bottom << 8 | 64) + payload


INNER = eth(0x0800, 3, 4) + ip4(6, "10.0.0.1", "10.0.0.2", tcp(1000, 80, flags=2))
CASES = {
    "Ethernet/IPv4/TCP": eth(0x0800) + ip4(6, "1.2.3.4", "5.6.7.8", tcp(5, 6)),
    "Ethernet/Dot1Q/Dot1Q/IPv6/UDP": eth(0x8100) + struct.pack(">HHHH", 7, 0x8100, 9, 0x86DD) + ip6(17, udp(1, 2, b"xx")),
    "Ethernet/IPv4/UDP/VXLAN|Ethernet/IPv4/TCP": eth(0x0800) + ip4(17, "1.1.1.1", "2.2.2.2", udp(50_000, 4789, vxlan(77, INNER))),
    "Ethernet/IPv4/GRE|IPv4/UDP": eth(0x0800) + ip4(47, "1.1.1.1", "2.2.2.2", gre(0x0800, ip4(17, "3.3.3.3", "4.4.4.4", udp(1, 2)), key=99)),
    "Ethernet/IPv4/GRE/MPLS|IPv4/TCP": eth(0x0800) + ip4(47, "1.1.1.1", "2.2.2.2", gre(0x8847, mpls(5, ip4(6, "3.3.3.3", "4.4.4.4", tcp(1, 2))))),
    "Ethernet/MPLS|MPLS|IPv4/UDP": eth(0x8847) + mpls(5, mpls(6, ip4(17, "3.3.3.3", "4.4.4.4", udp(1, 2))), bottom=False),
    "Ethernet/IPv4/UDP/Geneve|Ethernet/IPv4/TCP": eth(0x0800) + ip4(17, "1.1.1.1", "2.2.2.2", udp(1, 6081, b"\x01\0\x65\x58\0\0\x2a\0" + b"optn" + INNER)),
    "Ethernet/IPv4/GRE|Ethernet/IPv4/UDP/VXLAN|Ethernet/IPv4/TCP": eth(0x0800) + ip4(47, "1.1.1.1", "2.2.2.2", gre(0x6558, eth(0x0800) + ip4(17, "8.8.8.8", "9.9.9.9", udp(1, 4789, vxlan(8, INNER))))),
    "Ethernet/ARP": eth(0x0806) + bytes(28), "Ethernet": eth(0x1234) + b"zz", "Ethernet/IPv4": eth(0x0800) + ip4(6, "1.2.3.4", "5.6.7.8", b"short"),
}


def raw(spark, rows):
    return spark.createDataFrame([(at, bytearray(d), link) for at, d, link in rows], "timestamp long, data binary, link_type int")


def test_levels_of_packets(spark):
    rows = raw(spark, [(i, d, 1) for i, d in enumerate(CASES.values())] + [(50, b"", 1), (51, b"abc", 1), (52, CASES["Ethernet/IPv4/TCP"], 99)])
    got = {}
    for r in layers.levels(rows).orderBy("timestamp", "level").collect():
        got.setdefault(r["timestamp"], []).append(r)
    assert ["|".join(r["layers_path"] for r in got[i]) for i in range(len(CASES))] == list(CASES)
    assert len(got) == len(CASES)
    by = {k: got[i] for i, k in enumerate(CASES)}
    a, b = by["Ethernet/IPv4/UDP/VXLAN|Ethernet/IPv4/TCP"]
    assert (a["network_id"], a["network_a"], a["transport_b"], b["network_a"], b["transport_b"], b["flags"], b["link_a"]) == (77, "1.1.1.1", 4789, "10.0.0.1", 80, "SYN", "02:00:00:00:00:03")
    assert a["bytes"] == 14 + 20 + 8 + 8 + len(INNER) and b["bytes"] == len(INNER)
    assert by["Ethernet/IPv4/GRE|IPv4/UDP"][0]["network_id"] == 99 and by["Ethernet/IPv4/UDP/Geneve|Ethernet/IPv4/TCP"][0]["network_id"] == 42
    assert by["Ethernet/Dot1Q/Dot1Q/IPv6/UDP"][0]["link_id"] == 9 << 12 | 7 and by["Ethernet/Dot1Q/Dot1Q/IPv6/UDP"][0]["network_a"].endswith("01")


def test_a_packet_with_very_many_headers_is_walked_to_its_end(spark):
    data = ip4(17, "1.1.1.1", "2.2.2.2", udp(1, 2))
    for label in range(40):
        data = mpls(label, data, bottom=label == 0)
    paths = [r["layers_path"] for r in layers.levels(raw(spark, [(1, eth(0x8847) + data, 1)])).orderBy("level").collect()]
    assert paths == ["Ethernet/MPLS", *["MPLS"] * 39, "IPv4/UDP"]


def test_flows_of_tunnels_have_parents(spark):
    inner = lambda port: eth(0x0800, 3, 4) + ip4(6, "10.0.0.1", "10.0.0.2", tcp(port, 80, flags=2))
    back = lambda port: eth(0x0800, 4, 3) + ip4(6, "10.0.0.2", "10.0.0.1", tcp(80, port))
    out = lambda payload: eth(0x0800) + ip4(17, "2.2.2.2", "1.1.1.1", udp(9, 4789, vxlan(5, payload)))
    home = lambda payload: eth(0x0800, 2, 1) + ip4(17, "1.1.1.1", "2.2.2.2", udp(4789, 9, vxlan(5, payload)))
    rows = [(0, out(inner(1)), 1), (5, home(back(1)), 1), (7, out(inner(2)), 1), (10_000_000, out(inner(1)), 1), (20, inner(1), 1)]
    got = tunnels.flows(raw(spark, rows)).collect()
    outer = sorted((r for r in got if r["level"] == 0 and r["network_id"] == 5), key=lambda r: r["start"])
    assert [(r["start"], r["last"], r["ab_packets"], r["ba_packets"], r["network_a"], r["parent_uuid"]) for r in outer] == [(0, 7, 2, 1, "2.2.2.2", ""), (10_000_000, 10_000_000, 1, 0, "2.2.2.2", "")]
    children = sorted(((r["transport_a"], r["start"], r["ab_packets"], r["ba_packets"], r["parent_uuid"]) for r in got if r["level"] == 1), key=str)
    assert children == sorted([(1, 0, 1, 1, outer[0]["uuid"]), (2, 7, 1, 0, outer[0]["uuid"]), (1, 10_000_000, 1, 0, outer[1]["uuid"])], key=str)
    assert len({r["uuid"] for r in got}) == len(got) == 6  # the same inner packet without a tunnel is another flow
    assert tunnels.flows(raw(spark, [])).count() == 0


def plain_datagrams(rows, ttl):
    """(key, fragments, errors, bytes, overlapped, missing, whole) by byte sets."""
    out, open_ = [], {}

    def close(key):
        got = open_.pop(key)
        good = [(b, e, m) for _, b, e, m in got if e > b and e <= 65_535 and not (m and (e - b) % 8)]
        seen = set().union(*[range(b, e) for b, e, _ in good]) if good else set()
        top = max((e for _, e, _ in good), default=0)
        stops = [e for _, e, m in good if not m]
        out.append((*key, got[0][0], max(g[0] for g in got), len(got), len(got) - len(good), len(seen), sum(e - b for b, e, _ in good) - len(seen), top - len(seen), bool(stops) and min(stops) == top and len(seen) == top))

    for key, at, b, e, m in sorted(rows, key=lambda r: r[1]):
        if key in open_ and at - max(g[0] for g in open_[key]) > ttl:
            close(key)
        open_.setdefault(key, []).append((at, b, e, m))
    for key in list(open_):
        close(key)
    return sorted(out)


def fragment_rows(seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(120):
        at += rng.choice([1, 5, 100, 2000])
        key = ("1.1.1.1", "2.2.2.2", 17, rng.randrange(4))
        b = 8 * rng.randrange(5)
        rows.append((key, at, b, b + rng.choice([8, 16, 8, 0, 5]), rng.random() < 0.8))
    return rows


FRAGMENT = "network_a string, network_b string, protocol long, ip_id long, at long, begin long, end long, more boolean"


@pytest.mark.parametrize("seed", [1, 2])
def test_datagrams_equal_sets_of_bytes(spark, seed):
    rows = fragment_rows(seed)
    df = spark.createDataFrame([(*k, at, b, e, m) for k, at, b, e, m in rows] + [(None, "x", 1, 1, 1, 0, 8, True)], FRAGMENT)
    got = sorted(map(tuple, fragments.batch(df, 3000).collect()))
    assert got == plain_datagrams(rows, 3000) and any(r[-1] for r in got) and any(not r[-1] for r in got)


def ended(spark, tmp_path, frame, end, make):
    """All rows that a stream of the frame tells, once a last row has moved the time on."""
    frame.repartition(1).write.parquet(str(tmp_path / "in1"))
    end.write.parquet(str(tmp_path / "in2"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    name = f"told_{abs(hash(str(tmp_path)))}"
    make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


def test_datagrams_of_a_stream_equal_the_batch(spark, tmp_path):
    df = spark.createDataFrame([(*k, at, b, e, m) for k, at, b, e, m in fragment_rows(3)], FRAGMENT)
    end = spark.createDataFrame([("e", "e", 1, 1, 10**9, 0, 8, True)], FRAGMENT)
    assert ended(spark, tmp_path, df, end, lambda s: fragments.stream(s, 3000, "0 seconds")) == sorted(map(tuple, fragments.batch(df, 3000).collect()))


def test_packets_are_put_together(spark):
    payload = udp(7, 9, bytes(range(200)))
    cut = lambda b, e, more: eth(0x0800) + ip4(17, "1.1.1.1", "2.2.2.2", payload[b:e], 5, (0x2000 if more else 0) | b // 8)
    lone = eth(0x0800) + ip4(17, "1.1.1.1", "2.2.2.2", udp(1, 2), 6, 0x4000)
    rows = [(3, cut(64, 208, False), 1), (1, cut(0, 64, True), 1), (2, cut(32, 96, True), 1), (4, lone, 1), (9, eth(0x0800) + ip4(17, "1.1.1.1", "2.2.2.2", bytes(8), 8, 0x2000), 1), (10, eth(0x0806) + bytes(28), 1)]
    got = sorted((r["timestamp"], bytes(r["data"])) for r in fragments.reassembled(raw(spark, rows)).collect())
    assert got == [(3, eth(0x0800) + ip4(17, "1.1.1.1", "2.2.2.2", payload, 5)), (4, lone), (10, eth(0x0806) + bytes(28))]
    assert [r["transport_b"] for r in layers.levels(fragments.reassembled(raw(spark, rows))).filter("timestamp = 3").collect()] == [9]
    told = fragments.batch(fragments.of_packets(raw(spark, rows))).orderBy("ip_id").collect()
    assert [(r["ip_id"], r["fragments"], r["bytes"], r["overlapped"], r["whole"]) for r in told] == [(5, 3, 208, 64, True), (8, 1, 8, 0, False)]


def plain_segments(rows):
    out = {}
    for key, way, at, seq, length, flags in sorted(rows, key=lambda r: (r[2], r[3], r[4], r[5] or "")):
        s = out.setdefault((key, way), {"seen": set(), "place": None, "seq": None, "top": None, "n": 0, "again": 0, "late": 0, "ooo": 0, "lows": [], "syn": False, "end": False})
        flags = flags or ""
        s["place"] = seq if s["seq"] is None else s["place"] + (seq - s["seq"] + 2**31) % 2**32 - 2**31
        s["seq"] = seq
        begin = s["place"] + ("SYN" in flags)
        s["n"] += 1
        for x in range(begin, begin + length):
            if x in s["seen"]:
                s["again"] += 1
            else:
                s["seen"].add(x)
                s["ooo"] += s["top"] is not None and x < s["top"]
        s["late"] += s["top"] is not None and begin < s["top"]
        s["top"] = begin + length if s["top"] is None else max(s["top"], begin + length)
        s["lows"] += [begin, begin + length]
        s["syn"] |= "SYN" in flags
        s["end"] |= "FIN" in flags or "RST" in flags
    rows = []
    for (key, way), s in out.items():
        inside = [x in s["seen"] for x in range(min(s["lows"]), max(s["lows"]))]
        edges = {x for x in s["lows"]}
        holes, was = 0, True
        for i, x in enumerate(inside):
            at = min(s["lows"]) + i
            holes += not x and (was or at in edges)
            was = x
        rows.append((key, way, s["n"], len(s["seen"]), s["again"], inside.count(False), holes, s["late"], s["ooo"], s["syn"], s["end"]))
    return sorted(rows)


def segment_rows(seed, start):
    rng = random.Random(seed)
    rows, at = [], 1
    for key in ("k1", "k2"):
        for way in ("AB", "BA"):
            isn = (start + rng.randrange(40)) % 2**32
            rows.append((key, way, at, isn, 0, "SYN"))
            for _ in range(40):
                at += rng.randrange(3)
                rows.append((key, way, at, (isn + 1 + 5 * rng.randrange(30)) % 2**32, rng.choice([5, 10, 15]), rng.choice([None, "ACK", "ACK|FIN"])))
    return rows


SEGMENT = "flow_key string, direction string, at long, seq long, length long, flags string"


@pytest.mark.parametrize("start", [1000, 2**32 - 60])  # the second one wraps around
def test_segments_equal_sets_of_bytes(spark, start):
    rows = segment_rows(5, start)
    df = spark.createDataFrame(rows + [("k1", "AB", 1, None, 5, None)], SEGMENT)
    assert sorted(map(tuple, segments.batch(df).collect())) == plain_segments(rows)


def test_segments_beyond_four_gigabytes(spark):
    step = 2**30
    rows = [("k", "AB", i, (i * step) % 2**32, step, "ACK") for i in range(9)]
    r = segments.batch(spark.createDataFrame(rows, SEGMENT)).first()
    assert (r["bytes"], r["missing"], r["retransmitted"], r["late"]) == (9 * step, 0, 0, 0)


def test_segments_of_a_stream_equal_the_batch(spark, tmp_path):
    df = spark.createDataFrame(segment_rows(6, 2**32 - 70), SEGMENT)
    end = spark.createDataFrame([("e", "AB", 10**9, 0, 1, "ACK")], SEGMENT)
    assert ended(spark, tmp_path, df, end, lambda s: segments.stream(s, 60_000, "0 seconds")) == sorted(map(tuple, segments.batch(df).collect()))


def test_segments_of_packets(spark):
    a = eth(0x0800) + ip4(6, "1.1.1.1", "2.2.2.2", tcp(5, 6, 100, 2))
    b = eth(0x0800) + ip4(6, "1.1.1.1", "2.2.2.2", tcp(5, 6, 101, 24, b"hello"))
    c = eth(0x0800) + ip4(6, "2.2.2.2", "1.1.1.1", tcp(6, 5, 7, 17, b"yo") ) + b"\0\0\0"  # padding isn't payload
    got = sorted(map(tuple, segments.batch(segments.of_packets(raw(spark, [(1, a, 1), (2, b, 1), (3, b, 1), (4, c, 1)]))).drop("flow_key").collect()))
    assert got == [("AB", 3, 5, 5, 0, 0, 1, 0, True, False), ("BA", 1, 2, 0, 0, 0, 0, 0, False, True)]


def test_side_a_sends_first(spark, tmp_path):
    rows = [("k", "BA", 1, 10), ("k", "AB", 5, 1), ("k", "AB", 6, 1), ("k", "AB", 10_000_000, 7), ("m", "AB", 3, 2)]
    df = spark.createDataFrame(rows, "flow_key string, direction string, at long, bytes long")
    expected = sorted([("k", 1, 6, 1, 10, 2, 2, "TIMEOUT"), ("k", 10_000_000, 10_000_000, 1, 7, 0, 0, "TIMEOUT"), ("m", 3, 3, 1, 2, 0, 0, "TIMEOUT")])
    assert sorted(map(tuple, flowtable.batch(df, initiator=True).collect())) == expected
    end = spark.createDataFrame([("e", "AB", 10**9, 0)], df.schema)
    assert ended(spark, tmp_path, df, end, lambda s: flowtable.stream(s, delay="0 seconds", initiator=True)) == expected
