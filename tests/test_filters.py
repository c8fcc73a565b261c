"""Packet filters: qualifiers, ranges, bytes and both versions of IP, against plain Python."""

import pytest

from loomgraph.operators.rawpackets import RawPackets
from tests.test_layers import eth, ip4, ip6, raw, tcp, udp

PACKETS = [
    eth(0x0800) + ip4(6, "10.0.0.1", "10.0.0.2", tcp(1000, 80, flags=2)),
    eth(0x0800) + ip4(6, "10.0.0.2", "10.0.0.1", tcp(443, 1000, flags=18)),
    eth(0x0800) + ip4(17, "10.0.1.1", "10.0.0.2", udp(80, 5)),
    eth(0x86DD) + ip6(17, udp(7, 80)),
    eth(0x0806) + bytes(28),
    eth(0x0800) + ip4(6, "10.0.0.9", "10.0.0.2", tcp(3, 4, flags=1), bits=5),
]
CASES = {
    "tcp port 80": [0], "udp port 80": [2, 3], "port 80 or 443": [0, 1, 2, 3], "ip host 10.0.0.1": [0, 1], "ip6 host 10.0.0.1": [], "portrange 1-5": [2, 5], "tcp dst portrange 1-100": [0, 5],
    "tcp[13] & 2 != 0": [0, 1], "tcp[tcpflags] & (tcp-syn|tcp-ack) = tcp-syn": [0], "udp[2:2] = 80": [3], "ip[9] == 17": [2], "ether[12:2] = 0x0806": [4], "ip[9] + 1 * 2 = 19": [2],
    "host ::1": [3], "src host ::1": [3], "dst host ::1": [], "net ::/64": [3], "net ::/127": [3], "ip6": [3], "host 10.0.0.1 and not 10.0.0.2": [], "host 10.0.0.9 or 10.0.1.1": [2, 5], "src net 10.0.0.0/24": [0, 1, 5],
    "not (tcp || udp)": [4], "tcp src port 443 && dst host 10.0.0.1": [1], "tcp port 80 or 1000": [0, 1], "udp and port 80": [2, 3], "greater 60 or arp": [3, 4],
}


def test_filters(spark):
    packets = RawPackets(None, raw(spark, [(i, d, 1) for i, d in enumerate(PACKETS)]))
    for text, expected in CASES.items():
        assert sorted(r["timestamp"] for r in packets.BPF(text).df.select("timestamp").collect()) == expected, text


@pytest.mark.parametrize("text", ["host fe80::zz", "host 10.0.0", "port x", "tcp[", "tcp[13] &", "tcp[13:3] = 1", "foo", "( tcp", "tcp port 80 )", "ip[9", "host", "foo[1] = 2"])
def test_errors(spark, text):
    with pytest.raises(ValueError):
        RawPackets(None, raw(spark, [(0, b"", 1)])).BPF(text)
