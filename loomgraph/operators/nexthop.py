"""Next hop of nodes for an address, from their routing tables and neighbours, as array functions.

Metadata: RoutingTables array<struct<Id, Src, Routes array<struct<Prefix string, NextHops
array<struct<IP string, IfIndex bigint, Priority bigint>>>>>>, Neighbors array<struct<IP, MAC>>.

Tables are tried in order; the first that decides is taken.  In a table the first matching route
that is no default and has a gateway wins; else the last matching one without a gateway, which means
the address itself; else the last default route's first gateway.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.predicates import ipv4

if TYPE_CHECKING:
    from loomgraph.operators.elements import Nodes

DEFAULT = "0.0.0.0/0"


def _default(route: Column) -> Column:
    return route["Prefix"].isNull() | route["Prefix"].isin("", DEFAULT)


def _contains(route: Column, ip: str) -> Column:
    bits = F.split_part(route["Prefix"], F.lit("/"), F.lit(2)).try_cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - F.coalesce(bits, F.lit(32))).cast("bigint")
    return F.coalesce(F.floor(ipv4(route["Prefix"]) / size) == F.floor(ipv4(F.lit(ip)) / size), F.lit(False))


def next_hop(nodes: "Nodes", ip: str) -> DataFrame:
    """Rows (id, ip, mac, if_index) of the nodes that have a next hop."""
    tables, neighbors = nodes.fields.find("RoutingTables"), nodes.fields.find("Neighbors")
    if tables is None:
        return nodes.df.limit(0).select("id", F.lit("").alias("ip"), F.lit("").alias("mac"), F.lit(0).cast("bigint").alias("if_index"))

    def hop(address: Column, index: Column) -> Column:
        return F.struct(address.alias("ip"), index.cast("bigint").alias("if_index"))

    def decide(table: Column) -> Column:
        matching = F.flatten(F.transform(F.filter(table["Routes"], lambda r: ~_default(r) & _contains(r, ip)), lambda r: r["NextHops"]))
        via = F.filter(matching, lambda h: h["IP"].isNotNull())
        link = F.filter(matching, lambda h: h["IP"].isNull())
        fallback = F.filter(table["Routes"], _default)
        gate = F.get(F.try_element_at(fallback, F.lit(-1))["NextHops"], F.lit(0))
        return (
            F.when(F.size(via) > 0, hop(F.get(via, F.lit(0))["IP"], F.get(via, F.lit(0))["IfIndex"]))
            .when(F.size(link) > 0, hop(F.lit(ip), F.try_element_at(link, F.lit(-1))["IfIndex"]))
            .when((F.size(fallback) > 0) & gate["IP"].isNotNull(), hop(gate["IP"], gate["IfIndex"]))
        )

    found = F.get(F.filter(F.transform(tables[0], decide), lambda h: h.isNotNull()), F.lit(0))
    rows = nodes.df.select("id", found.alias("h"), (neighbors[0] if neighbors else F.lit(None)).alias("_n")).filter("h is not null")
    mac = F.get(F.filter("_n", lambda n: n["IP"] == F.col("h.ip")), F.lit(0))["MAC"] if neighbors else F.lit(None).cast("string")
    return rows.select("id", F.col("h.ip").alias("ip"), F.coalesce(mac, F.lit("")).alias("mac"), F.col("h.if_index").alias("if_index"))
