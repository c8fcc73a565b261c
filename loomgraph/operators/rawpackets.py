"""Raw packets of flows, and filters on their bytes as binary expressions inside the JVM."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.packets import IPV4, IPV6, PROTOCOLS, bytes_at, network, number, protocol, tagged, transport, version

if TYPE_CHECKING:
    from loomgraph.operators.flows import Flows
    from loomgraph.plans.graph import Graph

#: Packets that are kept of a flow.
LIMIT = 10


@dataclass
class RawPackets:
    graph: "Graph"
    df: DataFrame

    def Count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))

    def BPF(self, expression: str) -> "RawPackets":
        """Packets that meet the expression: conditions with ``not``, ``and``, ``or`` and parentheses.

        Conditions: ip, ip6, arp, tcp, udp, icmp, icmp6, sctp, vlan [N], [PROTOCOL] [src|dst] host A, [PROTOCOL] [src|dst] net A/N,
        [PROTOCOL] [src|dst] port N, [PROTOCOL] [src|dst] portrange N-M, ether [src|dst] [host] MAC, less N, greater N, and relations of
        numbers and bytes: PROTOCOL[PLACE] or PROTOCOL[PLACE:SIZE] with ``& | + *`` and ``= != < > <= >=``.  Addresses are of IP version
        4 or 6.  A bare address or number behind ``and`` or ``or`` has the qualifiers of the condition before it.
        ``not`` binds closest; ``and`` and ``or`` bind alike, from the left.
        """
        words = _WORDS.findall(expression)
        if "".join(words) != re.sub(r"\s+", "", expression):
            raise ValueError(f"unknown sign in: {expression}")
        words = [{"&&": "and", "||": "or", "!": "not", "==": "="}.get(w, w) for w in words]
        condition, rest = _expression(words, [])
        if rest:
            raise ValueError(f"unexpected: {' '.join(rest)}")
        return RawPackets(self.graph, self.df.filter(F.coalesce(condition, F.lit(False))))


_WORDS = re.compile(r"&&|\|\||!=|>=|<=|==|[()!=<>&|+*\[\]]|[^\s()!=<>&|+*\[\]]+")
_KINDS = ("host", "net", "port", "portrange")
#: Names of places and bits in byte relations.
NAMES = {"tcpflags": 13, "icmptype": 0, "icmpcode": 1, "tcp-fin": 1, "tcp-syn": 2, "tcp-rst": 4, "tcp-push": 8, "tcp-ack": 16, "tcp-urg": 32}
_BINDS = {"|": 1, "&": 2, "+": 3, "*": 4}
_RELATIONS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def _expression(words: list[str], before: list[str]) -> tuple[Column, list[str]]:
    """*before* holds the qualifiers of the latest condition."""
    out, rest = _factor(words, before)
    while rest and rest[0] in ("and", "or"):
        joint = rest[0]
        right, rest = _factor(rest[1:], before)
        out = out & right if joint == "and" else out | right
    return out, rest


def _factor(words: list[str], before: list[str]) -> tuple[Column, list[str]]:
    if words and words[0] == "not":
        inner, rest = _factor(words[1:], before)
        return ~F.coalesce(inner, F.lit(False)), rest
    if words and words[0] == "(":
        inner, rest = _expression(words[1:], before)
        if not rest or rest[0] != ")":
            raise ValueError("a parenthesis isn't closed")
        return inner, rest[1:]
    if len(words) > 1 and (words[1] == "[" or words[1] in _RELATIONS or words[1] in _BINDS):
        return _relation(words)
    end = next((i for i, w in enumerate(words) if w in ("and", "or", "not", "(", ")")), len(words))
    term = words[:end]
    if len(term) == 1 and before and term[0] not in ("ip", "ip6", "arp", "vlan", *PROTOCOLS):
        term = before + term
    if len(term) > 1 and term[-2] in _KINDS:
        before[:] = term[:-1]
    return F.coalesce(_term(term), F.lit(False)), words[end:]


def _relation(words: list[str]) -> tuple[Column, list[str]]:
    left, rest = _sum(words, 0)
    if not rest or rest[0] not in _RELATIONS:
        raise ValueError(f"no relation: {' '.join(words)}")
    right, after = _sum(rest[1:], 0)
    return F.coalesce(_RELATIONS[rest[0]](left, right), F.lit(False)), after


def _sum(words: list[str], least: int) -> tuple[Column, list[str]]:
    """A number of bytes and signs, each sign binding as in _BINDS."""
    out, rest = _number(words)
    while rest and _BINDS.get(rest[0], 0) > least:
        sign = rest[0]
        right, rest = _sum(rest[1:], _BINDS[sign])
        out = {"|": out.bitwiseOR, "&": out.bitwiseAND, "+": out.__add__, "*": out.__mul__}[sign](right)
    return out, rest


def _number(words: list[str]) -> tuple[Column, list[str]]:
    if not words:
        raise ValueError("a number is missing")
    if words[0] == "(":
        out, rest = _sum(words[1:], 0)
        if not rest or rest[0] != ")":
            raise ValueError("a parenthesis isn't closed")
        return out, rest[1:]
    if len(words) > 3 and words[1] == "[" and words[3] == "]":
        place, _, size = words[2].partition(":")
        if size not in ("", "1", "2", "4"):
            raise ValueError(f"bytes are taken by 1, 2 or 4: {words[2]}")
        base, able = _base(words[0])
        return F.when(able, number(base + (NAMES[place] if place in NAMES else int(place)), int(size or 1))), words[4:]
    return F.lit(NAMES[words[0]] if words[0] in NAMES else int(words[0], 0)).cast("bigint"), words[1:]


def _base(name: str) -> tuple[Column, Column]:
    """Where a protocol's header begins, and which packets have one."""
    if name == "ether":
        return F.lit(0), F.col("link_type") == 1
    if name in ("ip", "ip6", "arp"):
        return network(), _is(name)
    if name in PROTOCOLS:
        return transport(), _is(name) & ~((version() == 4) & (number(network() + 6, 2) % 8192 != 0))
    raise ValueError(f"unknown header: {name}")


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _is(name: str) -> Column:
    ethernet, kind = F.col("link_type") == 1, number(network() - 2, 2)
    if name == "ip":
        return F.when(ethernet, kind == IPV4).otherwise(version() == 4)
    if name == "ip6":
        return F.when(ethernet, kind == IPV6).otherwise(version() == 6)
    if name == "arp":
        return ethernet & (kind == 0x0806)
    return protocol() == PROTOCOLS[name]


def _inside(text: str, sides: list[int]) -> Column:
    """Whether an end's address is that, or in that network."""
    wanted = ipaddress.ip_network(text, strict=False)  # a ValueError names what isn't an address
    base = network()
    if wanted.version == 4:
        size = wanted.num_addresses
        return (version() == 4) & _any([F.floor(number(base + 12 + 4 * s, 4) / size) == int(wanted.network_address) // size for s in sides])
    whole, left = divmod(wanted.prefixlen, 8)
    prefix = wanted.network_address.packed.hex()

    def same(at: Column) -> Column:
        out = F.lit(True) if not whole else bytes_at(at, whole) == prefix[: 2 * whole]
        return out & (F.floor(number(at + whole, 1) / (1 << (8 - left))) == int(prefix[2 * whole : 2 * whole + 2], 16) >> (8 - left)) if left else out

    return (version() == 6) & _any([same(base + 8 + 16 * s) for s in sides])


def _term(words: list[str]) -> Column:
    ethernet = F.col("link_type") == 1
    if words and words[0] == "ether":
        sides = {"src": [6], "dst": [0]}.get(words[1] if len(words) > 1 else "", [0, 6])
        mac = words[-1].replace(":", "").lower()
        return ethernet & _any([bytes_at(F.lit(s), 6) == mac for s in sides])
    if words and words[0] == "vlan" and len(words) <= 2:
        return tagged() & (number(F.lit(14), 2) % 4096 == int(words[1])) if len(words) == 2 else tagged()
    if len(words) == 1 and words[0] in ("ip", "ip6", "arp", *PROTOCOLS):
        return _is(words[0])
    if len(words) == 2 and words[0] in ("less", "greater"):
        size = F.octet_length("data")
        return size <= int(words[1]) if words[0] == "less" else size >= int(words[1])
    said = words
    able = F.lit(True)
    if words and words[0] in ("ip", "ip6", *PROTOCOLS):
        able, words = _is(words[0]), words[1:]
    way, rest = (words[0], words[1:]) if words and words[0] in ("src", "dst") else ("", words)
    sides = {"src": [0], "dst": [1], "": [0, 1]}[way]
    if len(rest) == 2 and rest[0] in ("host", "net"):
        return able & _inside(rest[1], sides)
    if len(rest) == 2 and rest[0] in ("port", "portrange"):
        low, _, high = rest[1].partition("-" if rest[0] == "portrange" else "\0")
        ports = protocol().isin(PROTOCOLS["tcp"], PROTOCOLS["udp"], PROTOCOLS["sctp"])
        return able & ports & _any([number(transport() + 2 * s, 2).between(int(low), int(high or low)) for s in sides])
    raise ValueError(f"unknown condition: {' '.join(said)}")


def of_flows(flows: "Flows") -> RawPackets:
    if flows.graph.raw_packets is None:
        raise ValueError("the graph has no raw packets")
    ids = flows.df.select(F.col("uuid").alias("flow_uuid")).distinct()
    return RawPackets(flows.graph, flows.graph.raw_packets.join(ids, "flow_uuid", "left_semi"))


def captured(packets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The packets that a capture keeps: the first *limit* of each flow in order of time, numbered from 1 as index.

    Spark keeps the first ones of a flow in each task before the shuffle, so a busy flow doesn't meet in one task.
    """
    order = W.partitionBy("flow_uuid").orderBy("timestamp", "index")
    return packets.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).withColumn("index", F.col("_n").cast("long")).drop("_n")
