"""Raw packets into packet rows of the flow table, as binary expressions inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes before the network header by link type (Ethernet, raw IP, null), Ethernet types, IP protocols.
HEADERS = {1: 14, 101: 0, 12: 0, 0: 4}
VLAN, IPV4, IPV6 = 0x8100, 0x0800, 0x86DD
PROTOCOLS = {"icmp": 1, "tcp": 6, "udp": 17, "icmp6": 58, "sctp": 132}
#: TCP flags by bit.
FLAGS = {1: "FIN", 2: "SYN", 4: "RST", 16: "ACK"}


def number(at: Column, size: int) -> Column:
    """The unsigned number of *size* bytes at a place of *data*; null beyond its end."""
    return F.conv(F.hex(F.substring("data", at + 1, F.lit(size))), 16, 10).cast("bigint")


def bytes_at(at: Column, size: int) -> Column:
    return F.lower(F.hex(F.substring("data", at + 1, F.lit(size))))


def tagged() -> Column:
    """Whether an Ethernet packet has a VLAN tag."""
    return (F.col("link_type") == 1) & (number(F.lit(12), 2) == VLAN)


def network(tag: Column | None = None) -> Column:
    """Where the network header begins; null for an unknown link type.  *tag* is :func:`tagged`, if it is known."""
    base = reduce(lambda c, kv: c.when(F.col("link_type") == kv[0], F.lit(kv[1])), HEADERS.items(), F.when(F.lit(False), F.lit(0)))
    return base + F.when(tagged() if tag is None else tag, 4).otherwise(0)


def version() -> Column:
    return F.floor(number(network(), 1) / 16)


def protocol() -> Column:
    """The IP protocol number, of version 4 or 6."""
    return F.when(version() == 4, number(network() + 9, 1)).when(version() == 6, number(network() + 6, 1))


def transport() -> Column:
    return network() + F.when(version() == 4, (number(network(), 1) % 16).cast("int") * 4).otherwise(40)


def _each(places: range, fn) -> Column:
    """An array of what *fn* makes of each place: code of one place, which the JVM can compile however many columns there are."""
    return F.transform(F.array(*[F.lit(i) for i in places]), fn)


def _dotted(at: Column) -> Column:
    return F.array_join(_each(range(4), lambda i: number(at + i, 1).cast("string")), ".")


def _mac(at: int) -> Column:
    return F.array_join(_each(range(at, at + 6), lambda i: bytes_at(i, 1)), ":")


def decoded(raw: DataFrame) -> DataFrame:
    """Adds link_a, link_b (MAC of source and target), vlan, network_a, network_b, protocol (name), transport_a, transport_b, icmp_type, icmp_id and flags.

    Places and kinds of headers are columns of their own, each made from those before it, so that a packet's bytes are read once for each.
    """
    d, ethernet = raw.withColumn("_tagged", tagged()), F.col("link_type") == 1
    d = d.withColumn("_network", network(F.col("_tagged")))
    base = F.col("_network")
    d = d.withColumn("_head", number(base, 1)).withColumn("_version", F.floor(F.col("_head") / 16))
    four, six = F.col("_version") == 4, F.col("_version") == 6
    d = d.withColumns({
        "_protocol": F.when(four, number(base + 9, 1)).when(six, number(base + 6, 1)),
        "_transport": base + F.when(four, (F.col("_head") % 16).cast("int") * 4).otherwise(40),
    })
    kind, begin = F.col("_protocol"), F.col("_transport")
    d = d.withColumn("_bits", F.when(kind == PROTOCOLS["tcp"], number(begin + 13, 1)))
    address = lambda a, b: F.when(four, _dotted(base + a)).when(six, bytes_at(base + b, 16))
    names = F.create_map(*[x for k, v in PROTOCOLS.items() for x in (F.lit(v).cast("bigint"), F.lit(k.upper()))])
    ports = kind.isin(PROTOCOLS["tcp"], PROTOCOLS["udp"], PROTOCOLS["sctp"])
    ping = kind.isin(PROTOCOLS["icmp"], PROTOCOLS["icmp6"])
    flags = F.when(kind == PROTOCOLS["tcp"], F.concat_ws("|", *[F.when(F.col("_bits").bitwiseAND(b) != 0, F.lit(n)) for b, n in FLAGS.items()]))
    return d.withColumns({
        "link_a": F.when(ethernet, _mac(6)), "link_b": F.when(ethernet, _mac(0)), "vlan": F.when(F.col("_tagged"), number(F.lit(14), 2) % 4096),
        "network_a": address(12, 8), "network_b": address(16, 24), "protocol": F.try_element_at(names, kind),
        "transport_a": F.when(ports, number(begin, 2)), "transport_b": F.when(ports, number(begin + 2, 2)), "flags": flags,
        "icmp_type": F.when(ping, number(begin, 1)), "icmp_id": F.when(ping, number(begin + 4, 2)),
    }).drop("_tagged", "_network", "_head", "_version", "_protocol", "_transport", "_bits")


def rows(raw: DataFrame, mode: str = "L2") -> DataFrame:
    """Packet rows (flow_key, direction, at, bytes, flags, network_a ...) of raw packets (timestamp, data, link_type).

    The key has the layers' ends in order, so both directions share it: with the hardware addresses in mode L2, from
    the network layer upwards in mode L3.  Side A is the end that comes first in that order, and a packet goes AB if
    A sent it; ends are compared by their hardware addresses in mode L2 if both are there, else by network address and port.
    """
    if mode not in ("L2", "L3"):
        raise ValueError("mode is L2 or L3")
    d = decoded(raw)
    here, there = F.struct("network_a", "transport_a"), F.struct("network_b", "transport_b")
    first = here <= there
    if mode == "L2":
        first = F.when(F.col("link_a") != F.col("link_b"), F.col("link_a") < F.col("link_b")).otherwise(first)
    d, first = d.withColumn("_first", first), F.col("_first")
    both = lambda a, b: [F.coalesce(F.when(first, F.col(x)).otherwise(F.col(y)).cast("string"), F.lit("")) for x, y in ((a, b), (b, a))]
    layers = (both("link_a", "link_b") + [F.coalesce(F.col("vlan").cast("string"), F.lit(""))] if mode == "L2" else []) + both("network_a", "network_b")
    key = F.concat_ws("/", *layers, F.coalesce("protocol", F.lit("")), *both("transport_a", "transport_b"))
    return d.select(
        key.alias("flow_key"), F.when(first, "AB").otherwise("BA").alias("direction"), F.col("timestamp").alias("at"), F.octet_length("data").cast("bigint").alias("bytes"),
        "flags", "link_a", "link_b", "network_a", "network_b", "protocol", "transport_a", "transport_b", "icmp_type", "icmp_id")
