"""Graph, flows, metrics and sockets over the star-schema tables.

Types of nodes: region, nation, customer, host (supplier), part, order.  ownership edges go from
region to nation, nation to customer and host, customer to order; layer2 edges from host to part.  A
line item is a flow from its supplier to the order's customer; events are metric series by user.
Only the columns that a query reads reach the scans: all of this is projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.graph import Graph
from loomgraph.sources.history import files

#: Metadata of nodes.
FIELDS = {
    "Type": "string", "Name": "string", "Key": "bigint", "NationKey": "bigint", "AcctBal": "double", "Segment": "string", "Size": "bigint",
    "Brand": "string", "RetailPrice": "double", "Status": "string", "Priority": "string", "TotalPrice": "double",
    "MAC": "string", "PeerIntfMAC": "string", "TID": "string", "IPV4": "array<string>",
}
#: Time from an order's first revision to its second.
REVISED = 30 * 86_400_000
#: Bytes of tables that make a shuffle partition, and bytes of shuffled rows up to which partitions are joined.
INPUT, SHUFFLED = 2 << 20, 8 << 20
#: Bytes of a table that a task reads at most where its rows are made into packets and walked: some 3 s of work for each MB.
READ = 16 << 20
#: Start of the first interface metric.
MEASURED = 1_704_067_200_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Has this session's shuffles dealt into a partition for each INPUT bytes of the tables, of which adaptive execution joins small ones up to SHUFFLED.

    What a task sorts or holds in a window then stays the same for larger tables; there are more tasks.
    """
    size = sum(fs.getContentSummary(where).getLength() for where, fs in (files(spark, f"{sf_dir}/{n}.parquet") for n in names))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(least, -(-size // INPUT))))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SHUFFLED))


def ms(column: str) -> str:
    return f"unix_millis(cast({column} as timestamp))"


def ip(key: str, net: int) -> str:
    """An address inside 10.<net>.0.0/16."""
    return f"concat('10.{net}.', cast({key} div 256 % 256 as string), '.', cast({key} % 256 as string))"


def _address_from(first: int, n: str) -> str:
    """Hex digits of the n-th address from a first one on: different for numbers below 2**32."""
    return f"lpad(hex(({first}L + {n}) % 4294967296L), 8, '0')"


def _elements(df: DataFrame, id: str, created: str, metadata: str, *more: str, updated: str | None = None, archived: str = "null", revision: int = 1) -> DataFrame:
    """SQL texts, so that a frame costs one call."""
    return df.selectExpr(
        f"{id} as id", "'spark' as host", "'star' as origin", f"cast({created} as bigint) as created_at", f"cast({updated or created} as bigint) as updated_at",
        "cast(null as bigint) as deleted_at", f"cast({archived} as bigint) as archived_at", f"cast({revision} as bigint) as revision", *more, f"{metadata} as metadata")


def _meta(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', cast({fields.get(k, 'null')} as {t})" for k, t in FIELDS.items()) + ")"


def _name(kind: str, key: str) -> str:
    return f"concat('{kind}/', cast({key} as string))"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: _table(spark, sf_dir, name)
    mac = lambda kind, key: f"concat('mac-{kind}-', cast({key} as string))"
    parts = [
        _elements(t("region"), _name("region", "r_regionkey"), "0", _meta(Type="'region'", Name="r_name", Key="r_regionkey")),
        _elements(t("nation"), _name("nation", "n_nationkey"), "0", _meta(Type="'nation'", Name="n_name", Key="n_nationkey")),
        _elements(t("customer"), _name("customer", "c_custkey"), "0", _meta(
            Type="'customer'", Name="c_name", Key="c_custkey", NationKey="c_nationkey", AcctBal="c_acctbal", Segment="c_mktsegment",
            MAC=mac("c", "c_custkey"), IPV4=f"array({ip('c_custkey', 1)})")),
        _elements(t("supplier"), _name("host", "s_suppkey"), "0", _meta(
            Type="'host'", Name="s_name", Key="s_suppkey", NationKey="s_nationkey", AcctBal="s_acctbal", TID=_name("host", "s_suppkey"),
            MAC=mac("s", "s_suppkey"), PeerIntfMAC=mac("c", "s_suppkey * 3"), IPV4=f"array({ip('s_suppkey', 2)}, {ip('s_suppkey', 3)})")),
        _elements(t("part"), _name("part", "p_partkey"), "0", _meta(Type="'part'", Name="p_name", Key="p_partkey", Size="p_size", Brand="p_brand", RetailPrice="p_retailprice")),
        _elements(t("orders"), _name("order", "o_orderkey"), ms("o_orderdate"), _meta(Type="'order'", Key="o_orderkey", Status="o_orderstatus", Priority="o_orderpriority", TotalPrice="o_totalprice")),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: _table(spark, sf_dir, name)

    def part(df: DataFrame, relation: str, parent: str, child: str) -> DataFrame:
        id = f"concat('own/', {child})" if relation == "ownership" else f"concat('l2/', {parent}, '/', {child})"
        return _elements(df, id, "0", f"named_struct('RelationType', '{relation}')", f"{parent} as parent", f"{child} as child")

    return reduce(DataFrame.unionByName, [
        part(t("nation"), "ownership", _name("region", "n_regionkey"), _name("nation", "n_nationkey")),
        part(t("customer"), "ownership", _name("nation", "c_nationkey"), _name("customer", "c_custkey")),
        part(t("supplier"), "ownership", _name("nation", "s_nationkey"), _name("host", "s_suppkey")),
        part(t("orders"), "ownership", _name("customer", "o_custkey"), _name("order", "o_orderkey")),
        part(t("lineitem").select("l_suppkey", "l_partkey").distinct(), "layer2", _name("host", "l_suppkey"), _name("part", "l_partkey")),
    ])


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders").selectExpr("o_orderkey as l_orderkey", "o_custkey"), "l_orderkey")
    cents = lambda c: f"cast(round({c} * 100) as bigint)"
    start, last = ms("l_shipdate"), f"({ms('l_shipdate')} + cast(l_quantity as bigint) * 1000)"
    layer = lambda protocol, a, b: f"named_struct('protocol', {protocol}, 'a', {a}, 'b', {b}, 'id', 0L)"
    protocol = "if(l_linestatus = 'O', 'TCP', 'UDP')"
    return rows.selectExpr(
        f"concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast({cents('l_extendedprice')} as string), cast({start} as string)) as uuid",
        f"concat('Ethernet/IPv4/', {protocol}) as layers_path", "l_returnflag as application", "concat('t/', cast(l_orderkey as string)) as tracking_id",
        "concat('l3/', cast(l_orderkey as string)) as l3_tracking_id", "'' as parent_uuid", f"{_name('host', 'l_suppkey')} as node_tid", "'capture' as capture_id",
        f"{start} as start", f"{last} as last", "'TIMEOUT' as finish_type",
        layer("'ETHERNET'", "concat('mac-s-', cast(l_suppkey as string))", "concat('mac-c-', cast(o_custkey as string))") + " as link",
        layer("'IPV4'", ip("l_suppkey", 2), ip("o_custkey", 1)) + " as network",
        layer(protocol, "l_partkey % 60000 + 1024", "cast(l_linenumber * 100 as bigint)") + " as transport",
        f"named_struct('ab_packets', cast(l_quantity as bigint), 'ab_bytes', {cents('l_extendedprice')}, 'ba_packets', {cents('l_discount')}, 'ba_bytes', {cents('l_tax')}, 'start', {start}, 'last', {last}, 'rtt', 0L) as metric")


def flow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("flow_uuid"), F.expr(ms("ts")).alias("start"), F.round(F.col("value") * 100).cast("bigint").alias("ab_packets"), F.get_json_object("props", "$.k").cast("bigint").alias("ab_bytes"), "event_id")
    last = F.coalesce(F.lead("start").over(W.partitionBy("flow_uuid").orderBy("start", "event_id")), F.col("start"))
    return rows.select("flow_uuid", "ab_packets", "ab_bytes", F.lit(1).cast("bigint").alias("ba_packets"), (F.col("event_id") % 7).cast("bigint").alias("ba_bytes"), "start", last.alias("last"), F.lit(0).cast("bigint").alias("rtt"))


def sockets(flow_rows: DataFrame) -> DataFrame:
    """A socket for every distinct 5-tuple of the flows to port 100."""
    return flow_rows.filter("transport.b = 100").select(
        F.col("node_tid").alias("node_id"), F.lit("proc").alias("process"), F.lit(1).cast("bigint").alias("pid"), F.col("application").alias("name"),
        F.col("network.a").alias("local_address"), F.col("transport.a").alias("local_port"), F.col("network.b").alias("remote_address"), F.col("transport.b").alias("remote_port"),
        F.col("transport.protocol").alias("protocol"), F.lit("ESTABLISHED").alias("state")).distinct()


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph; a table is set up when a step first needs it."""
    return Graph(
        lambda: nodes(spark, sf_dir), lambda: edges(spark, sf_dir), flows=lambda: flows(spark, sf_dir),
        flow_metrics=lambda: flow_metrics(spark, sf_dir), sockets=lambda: sockets(flows(spark, sf_dir)))


def routed(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers as hosts with nested metadata: an MTU, interface metrics, routing tables and neighbours; host k lies below host k div 2."""
    k = "s_suppkey"
    route = lambda prefix, hop: f"named_struct('Prefix', {prefix}, 'NextHops', array({hop}))"
    hop = lambda ip_, index: f"named_struct('IP', cast({ip_} as string), 'IfIndex', cast({index} as bigint), 'Priority', 0L)"
    routes = (
        f"concat(if({k} % 4 = 1, array({route(repr('10.1.1.0/24'), hop(f'concat({chr(39)}10.9.0.{chr(39)}, cast({k} % 250 as string))', 2))}), array()), "
        f"if({k} % 4 = 2, array({route(repr('10.1.0.0/16'), hop('null', 3))}), array()), "
        f"if({k} % 3 <> 0, array({route(repr('0.0.0.0/0'), hop(f'concat({chr(39)}10.9.1.{chr(39)}, cast({k} % 250 as string))', 4))}), array()))"
    )
    near = ", ".join(f"named_struct('IP', concat('10.9.{n}.', cast({k} % 250 as string)), 'MAC', concat('gw-{n}-', cast({k} % 250 as string)))" for n in (0, 1))
    meta = (
        f"named_struct('Type', 'host', 'Name', s_name, 'Key', cast({k} as bigint), 'Level', if({k} between 2 and 3, 1L, null), 'MTU', cast(1500 - 100 * ({k} % 3) as bigint), "
        f"'LastUpdateMetric', named_struct('RxBytes', cast({k} * 10 as bigint), 'TxBytes', cast(round(s_acctbal * 100) as bigint), 'Start', {MEASURED}L + 1000 * ({k} % 50), 'Last', {MEASURED}L + 1000 * ({k} % 50) + 60000), "
        f"'RoutingTables', array(named_struct('Id', 254L, 'Src', '', 'Routes', {routes})), 'Neighbors', array({near}))"
    )
    hosts = _table(spark, sf_dir, "supplier").filter(f"{k} > 0")
    links = hosts.filter(f"{k} > 1")
    edges_ = _elements(links, _name("up", k), "0", "named_struct('RelationType', 'layer2')", f"{_name('host', f'{k} div 2')} as parent", f"{_name('host', k)} as child")
    return Graph(_elements(hosts, _name("host", k), "0", meta), edges_)


def users(spark: SparkSession, sf_dir: str) -> Graph:
    """A flow for each user of the events, with the user's points as its stored metrics."""
    points = flow_metrics(spark, sf_dir)
    rows = points.groupBy(F.col("flow_uuid").alias("uuid")).agg(F.min("start").alias("start"), F.max("last").alias("last"))
    rows = rows.selectExpr("uuid", "if(cast(uuid as bigint) % 2 = 0, 'even', 'odd') as application", "uuid as tracking_id", "start", "last")
    return Graph(lambda: nodes(spark, sf_dir), lambda: edges(spark, sf_dir), flows=rows, flow_metrics=points)


def with_packets(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph with a raw packet for each flow: Ethernet, IPv4 and the first eight bytes of TCP or UDP."""
    def packets() -> DataFrame:
        byte = lambda n: f"lpad(hex({n}), 2, '0')"
        rows = flows(spark, sf_dir).selectExpr("uuid", "start", "network.a as na", "network.b as nb", "transport.protocol as protocol", "transport.a as ta", "transport.b as tb")
        address = lambda c: f"array_join(transform(split({c}, '[.]'), x -> {byte('cast(x as int)')}), '')"
        word = lambda c: f"lpad(hex({c}), 4, '0')"
        data = (
            "unhex(concat('020000000001', '020000000002', '0800', '450000000000000040', if(protocol = 'TCP', '06', '11'), '0000'"
            + f", {address('na')}, {address('nb')}, {word('ta')}, {word('tb')}, '00000000'))"
        )
        return rows.selectExpr("uuid as flow_uuid", "start as timestamp", "0L as index", f"{data} as data", "1 as link_type")

    base = graph(spark, sf_dir)
    base.raw_packets = packets()
    return base


def history(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders with two revisions: new at the order date, and with their status later."""
    rows, at = _table(spark, sf_dir, "orders"), ms("o_orderdate")
    id, later = _name("order", "o_orderkey"), f"{ms('o_orderdate')} + {REVISED}"
    one = _elements(rows, id, at, _meta(Type="'order'", Key="o_orderkey", Status="'NEW'"), archived=later)
    two = _elements(rows, id, at, _meta(Type="'order'", Key="o_orderkey", Status="o_orderstatus"), updated=later, revision=2)
    return Graph(one.unionByName(two), lambda: edges(spark, sf_dir))


def tunnelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw packets (timestamp, data, link_type): each line item sends one inside a tunnel of its kind, and large ones get a reply a second later.

    By the line's number modulo 5: no tunnel, VXLAN, GRE with a key, MPLS in GRE, Geneve.  Tunnels run from the supplier's to the part's address,
    what they carry from the order's address to 10.99.0.1, with the line's number as source port.  Keys beyond an address's bits go on in the tunnel's
    hardware address, in addresses beyond the part's net and in the targets behind 10.99.0.1, so that flows of different keys stay apart.
    """
    word = lambda n: f"lpad(hex({n}), 4, '0')"
    supplier, part, target = f"concat('0AC8', {word('l_suppkey % 65536')})", _address_from(0x0AC90000, "l_partkey"), _address_from(0x0A630001, "l_orderkey div 16777216")
    order = "concat('0A', lpad(hex(l_orderkey % 16777216), 6, '0'))"
    ip4 = lambda protocol, a, b: f"concat('450000000000000040', '{protocol}', '0000', {a}, {b})"

    def packet(forth: bool) -> str:
        ends = (lambda a, b: (a, b)) if forth else (lambda a, b: (b, a))
        ethernet = ", ".join(ends("'020000000001'", "'020000000002'")) + ", '0800'"
        around = ", ".join(ends("concat('02', lpad(hex(l_suppkey div 65536 + 1), 10, '0'))", "'020000000002'")) + ", '0800'"
        carried = ip4("06", *ends(order, target)) + ", " + ", ".join(ends(word("l_linenumber + 1024"), "'0050'")) + ", '00000001', '00000000', '5010', '000000000000'"
        outer = lambda protocol: ip4(protocol, *ends(supplier, part))
        udp = lambda port: ", ".join(ends("'C350'", f"'{port}'")) + ", '00000000'"
        vni = "lpad(hex(l_suppkey % 16777216), 6, '0')"
        kinds = [
            f"concat({ethernet}, {carried})",
            f"concat({around}, {outer('11')}, {udp('12B5')}, '08000000', {vni}, '00', {ethernet}, {carried})",
            f"concat({around}, {outer('2F')}, '20000800', lpad(hex(l_suppkey), 8, '0'), {carried})",
            f"concat({around}, {outer('2F')}, '00008847', '00005140', {carried})",
            f"concat({around}, {outer('11')}, {udp('17C1')}, '00006558', {vni}, '00', {ethernet}, {carried})",
        ]
        return "unhex(case l_linenumber % 5 " + " ".join(f"when {i} then {k}" for i, k in enumerate(kinds)) + " end)"

    rows = _table(spark, sf_dir, "lineitem")
    at = ms("l_shipdate")
    there = rows.selectExpr(f"{at} as timestamp", f"{packet(True)} as data", "1 as link_type")
    return there.unionByName(rows.filter("l_quantity >= 25").selectExpr(f"{at} + 1000 as timestamp", f"{packet(False)} as data", "1 as link_type"))


def fragmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw packets: a UDP datagram of each order from its customer, with a fragment of 16 bytes for each line; lines 3 come twice, urgent orders lose line 2.

    The datagram's id has the low 16 bits of the order's key, its target the others (10.6.0.1 and up), so that no two orders share a datagram.
    """
    rows = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders").selectExpr("o_orderkey as l_orderkey", "o_custkey", "o_orderpriority", f"{ms('o_orderdate')} as at"), "l_orderkey")
    rows = rows.withColumn("last", F.max("l_linenumber").over(W.partitionBy("l_orderkey"))).filter("not (l_linenumber = 2 and o_orderpriority = '1-URGENT')")
    word = lambda n: f"lpad(hex({n}), 4, '0')"
    bits = "(if(l_linenumber < last, 8192, 0) + (l_linenumber - 1) * 2)"
    data = f"unhex(concat('0200000000010200000000020800', '45000024', {word('l_orderkey % 65536')}, {word(bits)}, '4011', '0000', '0A05', {word('o_custkey % 65536')}, {_address_from(0x0A060001, 'l_orderkey div 65536')}, repeat('AB', 16)))"
    twice = rows.withColumn("copy", F.explode(F.when(F.col("l_linenumber") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.selectExpr("at + l_linenumber + 10 * copy as timestamp", f"{data} as data", "1 as link_type")
