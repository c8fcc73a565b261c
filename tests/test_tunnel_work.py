"""Headers are walked a batch at a time, flows of tunnels tell their parents' columns without a join, and cut-off or random packets are read as by plain Python."""

import random

import pyarrow as pa

from loomgraph.functions import layers
from loomgraph.plans.queries import QUERIES
from loomgraph.sources import star
from loomgraph.streaming import tunnels
from tests.test_layers import CASES, eth, ip4, raw, tcp, udp, vxlan

LEAST = {"Ethernet": 14, "Dot1Q": 4, "IPv4": 20, "IPv6": 40, "TCP": 20, "UDP": 8, "SCTP": 12, "GRE": 4, "VXLAN": 8, "Geneve": 8, "MPLS": 4, "ICMPv4": 8, "ICMPv6": 4, "ARP": 8}


def plain_walk(d, kind):
    """(name, at, size) of a packet's headers, one after another."""
    two = lambda at: int.from_bytes(d[at : at + 2])
    version = lambda at: {4: "IPv4", 6: "IPv6"}.get(d[at] >> 4) if at < len(d) else None
    name, at, out = {1: "Ethernet", 12: version(0), 101: version(0), 228: "IPv4", 229: "IPv6"}.get(kind), 0, []
    while name and at + LEAST[name] <= len(d):
        size = {"IPv4": d[at] % 16 * 4, "GRE": 4 + 4 * sum(d[at] & b > 0 for b in (0x80, 0x20, 0x10)), "Geneve": d[at] % 64 * 4 + 8}.get(name, LEAST[name])
        size = (d[at + 12] >> 4) * 4 if name == "TCP" else size
        if size < LEAST[name] or at + size > len(d):
            break
        out.append((name, at, size))
        if name in ("Ethernet", "Dot1Q", "GRE", "Geneve"):
            then = layers.ETHER_TYPES.get(two(at + (12 if name == "Ethernet" else 2)))
        elif name == "IPv4":
            then = layers.IP_PROTOCOLS.get(d[at + 9]) if two(at + 6) % 8192 == 0 else None
        elif name == "UDP":
            then = layers.UDP_PORTS.get(two(at + 2), layers.UDP_PORTS.get(two(at)))
        else:
            then = {"IPv6": layers.IP_PROTOCOLS.get(d[at + 6]), "VXLAN": "Ethernet", "MPLS": version(at + 4) if d[at + min(2, len(d) - 1)] % 2 else "MPLS"}.get(name)
        name, at = then, at + size
    return out


def test_walks_of_changed_and_cut_packets(spark):
    rng = random.Random(5)
    rows = [(0, b"", 1), (1, b"\x45", 101)]
    for d in list(CASES.values()) * 40:
        d = bytearray(d)
        for _ in range(rng.randrange(3)):
            d[rng.randrange(len(d))] = rng.choice([0, 1, 4, 6, 0x45, 0x46, 0x60, 47, 58, rng.randrange(256)])
        rows.append((len(rows), bytes(d[: rng.choice([len(d), rng.randrange(len(d) + 1)])]), rng.choice([1, 1, 1, 1, 101, 228, 229, 7])))
    got = {r["timestamp"]: [tuple(x) for x in r["layers"]] for r in layers.walked(raw(spark, rows)).collect()}
    assert got == {i: plain_walk(d, kind) for i, d, kind in rows}


def test_nulls_and_empty_batches(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, bytearray(CASES["Ethernet/ARP"]), None), (3, bytearray(CASES["Ethernet/ARP"]), 1)], "timestamp long, data binary, link_type int")
    assert [(r["timestamp"], r["layers_path"]) for r in layers.levels(rows).collect()] == [(3, "Ethernet/ARP")]
    assert sorted((r["timestamp"], len(r["layers"])) for r in layers.walked(rows).collect()) == [(1, 0), (2, 0), (3, 2)]
    assert layers.walked(rows).columns == [*rows.columns, "layers"] and rows.columns == ["timestamp", "data", "link_type"]
    assert list(layers._cut_batches([pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.int32())], names=["data", "link_type"])])) == []


def test_flows_tell_their_parents_columns(spark):
    out = lambda payload: eth(0x0800) + ip4(17, "2.2.2.2", "1.1.1.1", udp(9, 4789, vxlan(5, payload)))
    home = lambda payload: eth(0x0800, 2, 1) + ip4(17, "1.1.1.1", "2.2.2.2", udp(4789, 9, vxlan(5, payload)))
    inner = lambda n: eth(0x0800, 3, 4) + ip4(6, f"10.0.0.{n}", "10.0.0.9", tcp(n, 80))
    # the second packet's tunnel goes the other way than the flow's first one, and carries a flow that carries another
    rows = [(0, out(inner(1)), 1), (5, home(inner(2)), 1), (6, home(out(inner(3))), 1)]
    told = tunnels.flows(raw(spark, rows), around=("network_a", "start", "ab_packets", "layers_path")).collect()
    by = {r["uuid"]: r for r in told}
    assert sorted(r["level"] for r in told) == [0, 1, 1, 1, 2]
    for r in told:
        up = by.get(r["parent_uuid"])
        assert [r[f"parent_{c}"] for c in ("network_a", "start", "ab_packets", "layers_path")] == ([up[c] for c in ("network_a", "start", "ab_packets", "layers_path")] if up else [None] * 4)


def test_the_query_joins_nothing_and_reads_small_parts(spark):
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        plan = QUERIES["tunnel_flows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and int(spark.conf.get("spark.sql.files.maxPartitionBytes")) == star.READ
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
