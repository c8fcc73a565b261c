"""Queries of the graph and flow steps over the star-schema tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.predicates import Between, Gt, Gte, Inside, Ipv4Range, Lt, Lte, Ne, Nee, Regex, Within, Without, metadata
from loomgraph.operators import linkers, metrics
from loomgraph.plans.graph import Graph
from loomgraph.sources import star
from loomgraph.streaming import flowtable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The same graph in SQL.
NODES = """nodes AS (
 SELECT 'region/'||r_regionkey id, 'region' typ, r_name nam, r_regionkey::BIGINT k, NULL::BIGINT nk, NULL::DOUBLE bal, NULL::VARCHAR seg, NULL::BIGINT siz, NULL::VARCHAR brand, NULL::VARCHAR status, NULL::VARCHAR mac, NULL::VARCHAR peer, NULL::VARCHAR tid, NULL::VARCHAR[] ip FROM region
 UNION ALL SELECT 'nation/'||n_nationkey, 'nation', n_name, n_nationkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
 UNION ALL SELECT 'customer/'||c_custkey, 'customer', c_name, c_custkey, c_nationkey, c_acctbal, c_mktsegment, NULL, NULL, NULL, 'mac-c-'||c_custkey, NULL, NULL, ['10.1.'||((c_custkey//256)%256)||'.'||(c_custkey%256)] FROM customer
 UNION ALL SELECT 'host/'||s_suppkey, 'host', s_name, s_suppkey, s_nationkey, s_acctbal, NULL, NULL, NULL, NULL, 'mac-s-'||s_suppkey, 'mac-c-'||(s_suppkey*3), 'host/'||s_suppkey, ['10.2.'||((s_suppkey//256)%256)||'.'||(s_suppkey%256), '10.3.'||((s_suppkey//256)%256)||'.'||(s_suppkey%256)] FROM supplier
 UNION ALL SELECT 'part/'||p_partkey, 'part', p_name, p_partkey, NULL, NULL, NULL, p_size, p_brand, NULL, NULL, NULL, NULL, NULL FROM part
 UNION ALL SELECT 'order/'||o_orderkey, 'order', NULL, o_orderkey, NULL, NULL, NULL, NULL, NULL, o_orderstatus, NULL, NULL, NULL, NULL FROM orders)"""
EDGES = """edges AS (
 SELECT 'own/nation/'||n_nationkey id, 'region/'||n_regionkey parent, 'nation/'||n_nationkey child, 'ownership' rel FROM nation
 UNION ALL SELECT 'own/customer/'||c_custkey, 'nation/'||c_nationkey, 'customer/'||c_custkey, 'ownership' FROM customer
 UNION ALL SELECT 'own/host/'||s_suppkey, 'nation/'||s_nationkey, 'host/'||s_suppkey, 'ownership' FROM supplier
 UNION ALL SELECT 'own/order/'||o_orderkey, 'customer/'||o_custkey, 'order/'||o_orderkey, 'ownership' FROM orders
 UNION ALL SELECT DISTINCT 'l2/host/'||l_suppkey||'/part/'||l_partkey, 'host/'||l_suppkey, 'part/'||l_partkey, 'layer2' FROM lineitem)"""
FLOWS = """flows AS (SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||CAST(round(l_extendedprice*100) AS BIGINT)||'-'||epoch_ms(l_shipdate) uuid,
 l_returnflag app, 't/'||l_orderkey track, 'host/'||l_suppkey tid, epoch_ms(l_shipdate) s, epoch_ms(l_shipdate)+CAST(trunc(l_quantity) AS BIGINT)*1000 l,
 'mac-s-'||l_suppkey la, 'mac-c-'||o_custkey lb, '10.2.'||((l_suppkey//256)%256)||'.'||(l_suppkey%256) na, '10.1.'||((o_custkey//256)%256)||'.'||(o_custkey%256) nb,
 CASE WHEN l_linestatus='O' THEN 'TCP' ELSE 'UDP' END proto, l_partkey%60000+1024 ta, l_linenumber*100 tb,
 CAST(trunc(l_quantity) AS BIGINT) abp, CAST(round(l_extendedprice*100) AS BIGINT) abb, CAST(round(l_discount*100) AS BIGINT) bap, CAST(round(l_tax*100) AS BIGINT) bab
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""
POINTS = """points AS (SELECT user_id::VARCHAR k, (epoch_us(ts)//1000) s, CAST(round(value*100) AS BIGINT) abp, CAST(json_extract_string(props,'$.k') AS BIGINT) abb, 1::BIGINT bap, (event_id%7)::BIGINT bab,
 coalesce(lead((epoch_us(ts)//1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts)//1000), event_id), (epoch_us(ts)//1000)) l FROM events)"""
#: Epoch ms of the contexts, and of the metric window: ten days of the events, by the hour.
POINT, FROM, TO = 880_000_000_000, 870_000_000_000, 880_000_000_000
WINDOW_START, WINDOW, BUCKET = 1_704_499_200_000, 864_000, 3600


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            with_ = ", ".join(t for name, t in (("nodes", NODES), ("edges", EDGES), ("flows", FLOWS), ("points", POINTS)) if f"{name}" in sql and f"{name} AS" not in sql)
            text = sql.strip()
            if with_:
                text = f"WITH RECURSIVE {with_}, {text.removeprefix('WITH RECURSIVE ').removeprefix('WITH ')}" if text.startswith("WITH") else f"WITH {with_} {text}"
            ORACLES[f.__name__] = text
        return f

    return add


def g(spark: SparkSession, sf_dir: str) -> Graph:
    return star.graph(spark, sf_dir)


def ids(found) -> DataFrame:
    return found.df.select("id")


# filters


@query("SELECT count(*) count FROM nodes")
def v_count(s, d):
    return g(s, d).V().Count()


@query("SELECT id, nam AS name FROM nodes WHERE id = 'nation/7'")
def v_by_id(s, d):
    return g(s, d).V("nation/7").df.select("id", F.col("metadata.Name").alias("name"))


@query("SELECT id FROM nodes WHERE typ='customer' AND seg='BUILDING'")
def v_has_str(s, d):
    return ids(g(s, d).V().Has("Type", "customer", "Segment", "BUILDING"))


@query("SELECT id FROM nodes WHERE trunc(bal)=100 OR k=100")
def v_has_int(s, d):
    return ids(g(s, d).V().HasEither("AcctBal", 100, "Key", 100))


@query("SELECT id FROM nodes WHERE siz IS NOT NULL AND siz<>7")
def v_has_ne(s, d):
    return ids(g(s, d).V().Has("Size", Ne(7)))


@query("SELECT count(*) count FROM nodes WHERE siz IS NULL OR siz<>7")
def v_has_nee(s, d):
    return g(s, d).V().Has("Size", Nee(7)).Count()


@query("SELECT id FROM nodes WHERE trunc(bal)<0")
def v_lt(s, d):
    return ids(g(s, d).V().Has("AcctBal", Lt(0)))


@query("SELECT id FROM nodes WHERE siz<=3")
def v_lte(s, d):
    return ids(g(s, d).V().Has("Size", Lte(3)))


@query("SELECT id FROM nodes WHERE siz>48")
def v_gt(s, d):
    return ids(g(s, d).V().Has("Size", Gt(48)))


@query("SELECT id FROM nodes WHERE siz>=48")
def v_gte(s, d):
    return ids(g(s, d).V().Has("Size", Gte(48)))


@query("SELECT id FROM nodes WHERE siz>10 AND siz<13")
def v_inside(s, d):
    return ids(g(s, d).V().Has("Size", Inside(10, 13)))


@query("SELECT id FROM nodes WHERE siz>=10 AND siz<13")
def v_between(s, d):
    return ids(g(s, d).V().Has("Size", Between(10, 13)))


@query("SELECT id FROM nodes WHERE brand IN ('Brand#2','Brand#3') AND siz IN (1,2,3)")
def v_within(s, d):
    return ids(g(s, d).V().Has("Brand", Within("Brand#2", "Brand#3"), "Size", Within(1, 2, 3)))


@query("SELECT count(*) count FROM nodes WHERE seg IS NULL OR seg NOT IN ('BUILDING','MACHINERY')")
def v_without(s, d):
    return g(s, d).V().Has("Segment", Without("BUILDING", "MACHINERY")).Count()


@query("SELECT id FROM nodes WHERE regexp_matches(nam, '^NATION_1.$')")
def v_regex(s, d):
    return ids(g(s, d).V().Has("Name", Regex("NATION_1.")))


@query("SELECT id FROM nodes WHERE list_bool_or([x LIKE '10.2.0.%' AND split_part(x,'.',4)::INT BETWEEN 16 AND 31 FOR x IN ip])")
def v_ipv4range(s, d):
    return ids(g(s, d).V().Has("IPV4", Ipv4Range("10.2.0.20/28")))


@query("SELECT count(*) count FROM nodes WHERE mac IS NOT NULL")
def v_haskey(s, d):
    return g(s, d).V().HasKey("MAC").Count()


@query("SELECT count(*) count FROM nodes WHERE mac IS NULL")
def v_hasnot(s, d):
    return g(s, d).V().HasNot("MAC").Count()


@query("SELECT id FROM nodes WHERE typ='region' OR siz=50")
def v_haseither(s, d):
    return ids(g(s, d).V().HasEither("Type", "region", "Size", 50))


@query("SELECT id, parent, child FROM edges WHERE rel='ownership' AND parent='nation/3'")
def e_has(s, d):
    return g(s, d).E().Has("RelationType", "ownership", "Parent", "nation/3").df.select("id", "parent", "child")


@query("SELECT count(*) count FROM nodes, (SELECT 1 FROM edges LIMIT 1)")
def g_mid_chain(s, d):
    return g(s, d).V().Has("Type", "region").G().V().Count()


# values and aggregates


@query("SELECT seg AS value FROM nodes WHERE seg IS NOT NULL")
def values(s, d):
    return g(s, d).V().Values("Segment").df.select("value")


@query("SELECT id, nam AS name, k AS key FROM nodes WHERE typ='nation'")
def valuemap(s, d):
    found = g(s, d).V().Has("Type", "nation").ValueMap("Name", "Key", "Nothing").df
    return found.select(F.col("_pos").alias("id"), F.col("value")["Name"].alias("name"), F.col("value")["Key"].cast("bigint").alias("key"))


@query("SELECT unnest(['@ID','@Host','@Origin','@CreatedAt','@UpdatedAt','@DeletedAt','@Revision','Type','Name','Key','NationKey','AcctBal','Segment','MAC','IPV4']) AS value")
def keys(s, d):
    return g(s, d).V().Has("Type", "customer").Keys().df.select("value")


@query("SELECT sum(siz)::BIGINT AS sum FROM nodes")
def sum_nodes(s, d):
    return g(s, d).V().Sum("Size")


@query("SELECT DISTINCT 'region/'||n_regionkey AS id FROM nation")
def dedup_id(s, d):
    return ids(g(s, d).V().Has("Type", "nation").In().Dedup())


@query("SELECT min(id) AS id FROM nodes WHERE brand IS NOT NULL GROUP BY brand, siz")
def dedup_keys(s, d):
    return ids(g(s, d).V().Has("Type", "part").Dedup("Brand", "Size"))


@query("SELECT id, siz AS size FROM nodes WHERE typ='part' ORDER BY siz DESC, id LIMIT 20")
def sort_limit(s, d):
    return g(s, d).V().Has("Type", "part").Sort("DESC", "Size").Limit(20).df.select("id", F.col("metadata.Size").alias("size"))


@query("SELECT id FROM nodes WHERE typ='customer' ORDER BY id LIMIT 15 OFFSET 10")
def range_(s, d):
    return ids(g(s, d).V().Has("Type", "customer").Range(10, 25))


@query("SELECT id FROM nodes WHERE typ IN ('region','nation')")
def as_select(s, d):
    graph = g(s, d)
    graph.V().Has("Type", "region").As("a")
    return ids(graph.V().Has("Type", "nation").As("b").Select("a", "b"))


@query("SELECT DISTINCT seg AS value FROM nodes WHERE seg IS NOT NULL")
def values_dedup(s, d):
    return g(s, d).V().Values("Segment").Dedup().df.select("value")


# adjacency


@query("SELECT n.id FROM nodes p JOIN edges e ON e.parent=p.id JOIN nodes n ON n.id=e.child WHERE p.typ='region'")
def out(s, d):
    return ids(g(s, d).V().Has("Type", "region").Out())


@query("SELECT n.id FROM nodes c JOIN edges e ON e.child=c.id JOIN nodes n ON n.id=e.parent WHERE c.typ='order' AND c.status='P'")
def in_(s, d):
    return ids(g(s, d).V().Has("Type", "order", "Status", "P").In())


@query("SELECT n.id FROM (SELECT parent a, child b FROM edges UNION ALL SELECT child, parent FROM edges) e JOIN nodes p ON p.id=e.a JOIN nodes n ON n.id=e.b WHERE p.typ='nation' AND n.typ<>'customer'")
def both(s, d):
    return ids(g(s, d).V().Has("Type", "nation").Both("Type", Ne("customer")))


@query("SELECT e.id FROM nodes p JOIN edges e ON e.parent=p.id WHERE p.typ='host' AND rel='layer2'")
def oute(s, d):
    return ids(g(s, d).V().Has("Type", "host").OutE("RelationType", "layer2"))


@query("SELECT e.id FROM nodes p JOIN edges e ON e.child=p.id WHERE p.typ='part' AND p.siz=9")
def ine(s, d):
    return ids(g(s, d).V().Has("Type", "part", "Size", 9).InE())


@query("SELECT e.id FROM nodes p JOIN edges e ON e.child=p.id OR e.parent=p.id WHERE p.typ='nation'")
def bothe(s, d):
    return ids(g(s, d).V().Has("Type", "nation").BothE())


@query("SELECT parent AS id FROM edges WHERE rel='ownership' AND child LIKE 'host/%'")
def inv(s, d):
    return ids(g(s, d).E().Has("RelationType", "ownership", "Child", Regex("host/.*")).InV())


@query("SELECT e.child AS id FROM edges e JOIN nodes n ON n.id=e.child WHERE rel='layer2' AND n.siz=4")
def outv(s, d):
    return ids(g(s, d).E().Has("RelationType", "layer2").OutV("Size", 4))


@query("SELECT parent AS id FROM edges WHERE rel='ownership' AND parent='nation/1' UNION ALL SELECT child FROM edges WHERE rel='ownership' AND parent='nation/1'")
def bothv(s, d):
    return ids(g(s, d).E().Has("RelationType", "ownership", "Parent", "nation/1").BothV())


@query("SELECT 'node' AS kind, id FROM nodes WHERE typ IN ('region','nation') UNION ALL SELECT 'edge', id FROM edges WHERE parent LIKE 'region/%' AND child LIKE 'nation/%'")
def subgraph_v(s, d):
    return g(s, d).V().Has("Type", Within("region", "nation")).SubGraph().Elements()


@query("SELECT DISTINCT 'node' AS kind, unnest([parent,child]) AS id FROM edges WHERE parent='nation/2' UNION ALL SELECT 'edge', id FROM edges WHERE parent='nation/2'")
def subgraph_e(s, d):
    return g(s, d).E().Has("Parent", "nation/2").SubGraph().Elements()


@query("SELECT 'added' AS change, 'node' AS kind, id FROM nodes WHERE typ='nation' UNION ALL SELECT 'removed', 'node', id FROM nodes WHERE typ='region' AND k<>0")
def diff(s, d):
    graph = g(s, d)
    old = graph.V().Has("Type", "region").SubGraph()
    new = graph.V().HasEither("Type", "nation", "Name", "AFRICA").SubGraph()
    return old.Diff(new).filter("kind = 'node'")


# paths


@query("WITH reach(id, n) AS (SELECT 'region/2', 0 UNION SELECT e.child, n+1 FROM reach JOIN edges e ON e.parent=reach.id AND e.rel='ownership' WHERE n<2) SELECT DISTINCT id FROM reach")
def descendants(s, d):
    return ids(g(s, d).V().Has("Type", "region", "Key", 2).Descendants("RelationType", "ownership", 2))


@query("WITH reach(id) AS (SELECT id FROM nodes WHERE typ='order' AND status='P' UNION SELECT e.parent FROM reach JOIN edges e ON e.child=reach.id AND e.rel='ownership') SELECT id FROM reach")
def ascendants(s, d):
    return ids(g(s, d).V().Has("Type", "order", "Status", "P").Ascendants("RelationType", "ownership", 0))


@query("WITH u AS (SELECT parent a, child b FROM edges UNION SELECT child, parent FROM edges), reach(id, n) AS (SELECT 'host/5', 0 UNION SELECT u.b, n+1 FROM reach JOIN u ON u.a=reach.id WHERE n<2) SELECT DISTINCT id FROM reach")
def neighbors(s, d):
    return ids(g(s, d).V("host/5").Neighbors(2))


@query("SELECT c.id AS start, CASE WHEN c.nk=0 THEN 2 WHEN n.n_regionkey=z.n_regionkey THEN 4 ELSE NULL END AS nodes FROM nodes c JOIN nation n ON n.n_nationkey=c.nk JOIN nation z ON z.n_nationkey=0 WHERE c.typ='host' AND (c.nk=0 OR n.n_regionkey=z.n_regionkey)")
def shortest_path_len(s, d):
    found = g(s, d).V().Has("Type", "host").ShortestPathTo(metadata("Type", "nation", "Key", 0), metadata("RelationType", "ownership"))
    start = found.df.groupBy("path_id").agg(F.min_by("id", "step").alias("start"), F.count(F.lit(1)).alias("nodes"))
    return start.select("start", "nodes")


# time


@query(f"SELECT 'order/'||o_orderkey AS id, CASE WHEN epoch_ms(o_orderdate)+{star.REVISED}<={POINT} THEN o_orderstatus ELSE 'NEW' END AS status, CASE WHEN epoch_ms(o_orderdate)+{star.REVISED}<={POINT} THEN 2 ELSE 1 END::BIGINT AS revision FROM orders WHERE epoch_ms(o_orderdate)<={POINT}")
def at_point(s, d):
    found = star.history(s, d).Context(POINT).V()
    return found.df.select("id", F.col("metadata.Status").alias("status"), "revision")


@query(f"SELECT 'order/'||o_orderkey AS id, 1::BIGINT AS revision FROM orders WHERE epoch_ms(o_orderdate)<={TO} AND epoch_ms(o_orderdate)+{star.REVISED}>={FROM} UNION ALL SELECT 'order/'||o_orderkey, 2 FROM orders WHERE epoch_ms(o_orderdate)+{star.REVISED}<={TO}")
def at_range(s, d):
    return star.history(s, d).Context(TO, (TO - FROM) // 1000).V().df.select("id", "revision")


# flows


@query("SELECT uuid FROM flows WHERE app='R' AND proto='TCP' AND abp>45")
def flows_has(s, d):
    return g(s, d).Flows().Has("Application", "R", "Transport.Protocol", "TCP", "Metric.ABPackets", Gt(45)).df.select("uuid")


@query("SELECT uuid FROM flows WHERE la='mac-s-3' OR lb='mac-s-3' OR na='10.1.0.9' OR nb='10.1.0.9'")
def flows_side(s, d):
    return g(s, d).Flows().HasEither("Link", "mac-s-3", "Network", "10.1.0.9").df.select("uuid")


@query("SELECT min(uuid) AS uuid FROM flows GROUP BY track")
def flows_dedup(s, d):
    return g(s, d).Flows().Dedup().df.select("uuid")


@query("SELECT uuid, l AS last FROM flows ORDER BY l DESC, uuid LIMIT 50")
def flows_sort_limit(s, d):
    return g(s, d).Flows().Sort("DESC", "Last").Limit(50).df.select("uuid", "last")


@query("SELECT id FROM flows JOIN (SELECT m, min(id) id FROM (SELECT id, unnest([mac,peer]) m FROM nodes) WHERE m IS NOT NULL GROUP BY m) x ON m=la WHERE app='R'")
def flows_in(s, d):
    return ids(g(s, d).Flows("Application", "R").In())


@query("SELECT id FROM flows JOIN (SELECT m, min(id) id FROM (SELECT id, unnest([mac,peer]) m FROM nodes WHERE typ='customer') WHERE m IS NOT NULL GROUP BY m) x ON m=lb WHERE app='R'")
def flows_out(s, d):
    return ids(g(s, d).Flows("Application", "R").Out("Type", "customer"))


@query("SELECT id FROM (SELECT la a FROM flows WHERE app='R' UNION ALL SELECT lb FROM flows WHERE app='R') JOIN (SELECT m, min(id) id FROM (SELECT id, unnest([mac,peer]) m FROM nodes) WHERE m IS NOT NULL GROUP BY m) x ON m=a")
def flows_both(s, d):
    return ids(g(s, d).Flows("Application", "R").Both())


@query("SELECT id FROM (SELECT la a FROM flows WHERE app='R' UNION ALL SELECT lb FROM flows WHERE app='R') JOIN nodes ON mac=a UNION ALL SELECT tid FROM flows WHERE app='R'")
def flows_nodes(s, d):
    return ids(g(s, d).Flows("Application", "R").Nodes())


@query("SELECT tid AS id FROM flows WHERE app='A'")
def flows_hops(s, d):
    return ids(g(s, d).Flows("Application", "A").Hops())


@query("SELECT sum(abb)::DOUBLE AS sum FROM flows WHERE app='N'")
def flows_sum(s, d):
    return g(s, d).Flows("Application", "N").Sum("Metric.ABBytes")


@query("SELECT track AS group_key, uuid FROM flows WHERE track IN (SELECT track FROM flows WHERE app='R' GROUP BY track HAVING count(*)>1) AND app='R'")
def flows_group_morethan(s, d):
    return g(s, d).Flows("Application", "R").Group().MoreThan().df.select("group_key", "uuid")


@query("SELECT uuid FROM flows JOIN nodes n ON n.tid=flows.tid WHERE n.nk=4")
def v_flows(s, d):
    return g(s, d).V().Has("Type", "host", "NationKey", 4).Flows().df.select("uuid")


@query("SELECT DISTINCT app AS value FROM flows")
def flows_values(s, d):
    return g(s, d).Flows().Values("Application").Dedup().df.select("value")


# metrics


@query("SELECT uuid AS key, abb AS ab_bytes FROM flows WHERE app='R'")
def metrics_of_flows(s, d):
    return g(s, d).Flows("Application", "R").Metrics().df.select("key", "ab_bytes")


@query("SELECT sum(abp)::BIGINT AS ab_packets, sum(abb)::BIGINT AS ab_bytes, sum(bap)::BIGINT AS ba_packets, sum(bab)::BIGINT AS ba_bytes, min(s) AS start, max(l) AS last FROM points")
def metrics_sum(s, d):
    return metrics.stored_points(g(s, d)).Sum()


#: A point's share of each bucket, cut off again and again: the recursion goes from bucket to bucket.
AGGREGATES = f"""WITH RECURSIVE w AS (SELECT *, row_number() OVER () AS r FROM points WHERE s < {WINDOW_START + WINDOW * 1000} AND l >= {WINDOW_START} AND s >= {WINDOW_START} AND l <= {WINDOW_START + WINDOW * 1000}),
fold(r, i, pos, l, s, a, b, c, e, pa, pb, pc, pe, a0, b0, c0, e0, done) AS (
 SELECT r, least((s-{WINDOW_START})//{BUCKET * 1000}, {WINDOW // BUCKET - 1}) - 1, s, l, s, abp, abb, bap, bab, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, abp, abb, bap, bab, false FROM w
 UNION ALL
 SELECT r, i, pos2, l, s, a-qa, b-qb, c-qc, e-qe, CASE WHEN z THEN a0 ELSE qa END, CASE WHEN z THEN b0 ELSE qb END, CASE WHEN z THEN c0 ELSE qc END, CASE WHEN z THEN e0 ELSE qe END, a0, b0, c0, e0, z OR l <= pos2 FROM (
  SELECT *, qa=0 AND qb=0 AND qc=0 AND qe=0 AND s >= pos2-{BUCKET * 1000} AND s < pos2 AS z FROM (
   SELECT r, i+1 AS i, {WINDOW_START}+(i+2)*{BUCKET * 1000} AS pos2, pos, l, s, a, b, c, e, a0, b0, c0, e0,
    CASE WHEN l <= {WINDOW_START}+(i+2)*{BUCKET * 1000} THEN a ELSE CAST(trunc(a*({WINDOW_START}+(i+2)*{BUCKET * 1000}-pos)::DOUBLE/(l-pos)) AS BIGINT) END qa,
    CASE WHEN l <= {WINDOW_START}+(i+2)*{BUCKET * 1000} THEN b ELSE CAST(trunc(b*({WINDOW_START}+(i+2)*{BUCKET * 1000}-pos)::DOUBLE/(l-pos)) AS BIGINT) END qb,
    CASE WHEN l <= {WINDOW_START}+(i+2)*{BUCKET * 1000} THEN c ELSE CAST(trunc(c*({WINDOW_START}+(i+2)*{BUCKET * 1000}-pos)::DOUBLE/(l-pos)) AS BIGINT) END qc,
    CASE WHEN l <= {WINDOW_START}+(i+2)*{BUCKET * 1000} THEN e ELSE CAST(trunc(e*({WINDOW_START}+(i+2)*{BUCKET * 1000}-pos)::DOUBLE/(l-pos)) AS BIGINT) END qe
   FROM fold WHERE NOT done AND i+1 < {WINDOW // BUCKET})))
SELECT {WINDOW_START}+i*{BUCKET * 1000} AS start, sum(pa)::BIGINT AS ab_packets, sum(pb)::BIGINT AS ab_bytes, sum(pc)::BIGINT AS ba_packets, sum(pe)::BIGINT AS ba_bytes FROM fold WHERE pos <> s OR i >= (s-{WINDOW_START})//{BUCKET * 1000} GROUP BY i"""


@query(AGGREGATES)
def metrics_aggregates(s, d):
    graph = g(s, d).Context((WINDOW_START + WINDOW * 1000), WINDOW)
    return metrics.stored_points(graph).Aggregates(BUCKET).df.select("start", "ab_packets", "ab_bytes", "ba_packets", "ba_bytes")


#: The same fold over the whole table, by the hour from the first point to the last.
LENGTH = 3600
AGGREGATES_WHOLE = f"""WITH RECURSIVE d AS (SELECT min(s) f, max(l) t, ceil((max(l)-min(s))/{LENGTH * 1000})::BIGINT n FROM points), w AS (SELECT points.*, f, n, row_number() OVER () AS r FROM points, d WHERE s < t),
fold(r, f, n, i, pos, l, s, a, b, c, e, pa, pb, pc, pe, a0, b0, c0, e0, done) AS (
 SELECT r, f, n, (s-f)//{LENGTH * 1000} - 1, s, l, s, abp, abb, bap, bab, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, abp, abb, bap, bab, false FROM w
 UNION ALL
 SELECT r, f, n, i, pos2, l, s, a-qa, b-qb, c-qc, e-qe, CASE WHEN z THEN a0 ELSE qa END, CASE WHEN z THEN b0 ELSE qb END, CASE WHEN z THEN c0 ELSE qc END, CASE WHEN z THEN e0 ELSE qe END, a0, b0, c0, e0, z OR l <= pos2 FROM (
  SELECT *, qa=0 AND qb=0 AND qc=0 AND qe=0 AND s >= pos2-{LENGTH * 1000} AND s < pos2 AS z FROM (
   SELECT r, f, n, i+1 AS i, f+(i+2)*{LENGTH * 1000} AS pos2, pos, l, s, a, b, c, e, a0, b0, c0, e0,
    CASE WHEN l <= f+(i+2)*{LENGTH * 1000} THEN a ELSE CAST(trunc(a*(f+(i+2)*{LENGTH * 1000}-pos)::DOUBLE/(l-pos)) AS BIGINT) END qa,
    CASE WHEN l <= f+(i+2)*{LENGTH * 1000} THEN b ELSE CAST(trunc(b*(f+(i+2)*{LENGTH * 1000}-pos)::DOUBLE/(l-pos)) AS BIGINT) END qb,
    CASE WHEN l <= f+(i+2)*{LENGTH * 1000} THEN c ELSE CAST(trunc(c*(f+(i+2)*{LENGTH * 1000}-pos)::DOUBLE/(l-pos)) AS BIGINT) END qc,
    CASE WHEN l <= f+(i+2)*{LENGTH * 1000} THEN e ELSE CAST(trunc(e*(f+(i+2)*{LENGTH * 1000}-pos)::DOUBLE/(l-pos)) AS BIGINT) END qe
   FROM fold WHERE NOT done AND i+1 < n)))
SELECT f+i*{LENGTH * 1000} AS start, sum(pa)::BIGINT AS ab_packets, sum(pb)::BIGINT AS ab_bytes, sum(pc)::BIGINT AS ba_packets, sum(pe)::BIGINT AS ba_bytes FROM fold WHERE i >= (s-f)//{LENGTH * 1000} GROUP BY f, i"""


@query(AGGREGATES_WHOLE)
def metrics_aggregates_whole(s, d):
    return metrics.stored_points(g(s, d)).Aggregates(LENGTH).df.select("start", "ab_packets", "ab_bytes", "ba_packets", "ba_bytes")


# sockets, links


@query("SELECT DISTINCT tid AS node, na AS local_address, ta AS local_port, nb AS remote_address, proto AS protocol, app AS name FROM flows WHERE tb=100 AND tid='host/1'")
def sockets(s, d):
    found = g(s, d).V("host/1").Sockets()
    return found.df.select(F.col("key").alias("node"), "local_address", "local_port", "remote_address", "protocol", "name")


@query("SELECT DISTINCT tid AS node, na AS local_address, ta AS local_port, nb AS remote_address, proto AS protocol, app AS name FROM flows WHERE tb=100")
def sockets_of_hosts(s, d):
    found = g(s, d).V().Has("Type", "host").Sockets()
    return found.df.select(F.col("key").alias("node"), "local_address", "local_port", "remote_address", "protocol", "name")


@query("SELECT f.uuid, x.app AS name FROM flows f JOIN (SELECT DISTINCT tid, app, na, ta, nb, tb, proto FROM flows WHERE tb=100) x ON (f.na=x.na AND f.ta=x.ta AND f.nb=x.nb AND f.tb=x.tb AND f.proto=x.proto) WHERE f.app='R'")
def flow_sockets(s, d):
    return g(s, d).Flows("Application", "R").Sockets().df.select(F.col("key").alias("uuid"), "name")


@query("SELECT DISTINCT a.id AS parent, b.id AS child FROM nodes a JOIN nodes b ON a.peer=b.mac WHERE a.id<>b.id")
def linker_peering(s, d):
    return linkers.peering(g(s, d)).select("parent", "child")


@query("SELECT DISTINCT a.id AS parent, b.id AS child FROM (SELECT id, unnest(ip) x FROM nodes WHERE typ='host') a JOIN (SELECT id, '10.2.'||((k//256)%256)||'.'||(k%256) x FROM nodes WHERE typ='customer') b USING (x)")
def linker_arrays(s, d):
    graph = g(s, d)
    theirs = graph.V().Has("Type", "customer").df.select("id", F.expr(star.ip("metadata.Key", 2)).alias("k0"))
    return linkers.link(linkers.index(graph.V().Has("Type", "host"), "IPV4"), theirs, "same address").select("parent", "child")


@query("SELECT (SELECT min(id) FROM nodes WHERE typ='region') AS parent, (SELECT min(id) FROM nodes WHERE typ='part') AS child")
def edge_rule(s, d):
    graph = g(s, d)
    return linkers.edge_rule(graph.V().Has("Type", "region"), graph.V().Has("Type", "part"), "rule").select("parent", "child")


#: Sessions of a user's events with gaps below ten minutes are the flows of the batch flow table.
@query("""WITH e AS (SELECT user_id, (epoch_us(ts)//1000) t, CAST(round(value*100) AS BIGINT) v, CASE WHEN event_type IN ('view','click') THEN 1 ELSE 0 END ab, coalesce((epoch_us(ts)//1000)-lag((epoch_us(ts)//1000)) OVER w > 600000, true)::INT fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY (epoch_us(ts)//1000))),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) n FROM e)
SELECT user_id::VARCHAR AS flow_key, min(t) AS start, max(t) AS last, sum(ab)::BIGINT AS ab_packets, sum(ab*v)::BIGINT AS ab_bytes, sum(1-ab)::BIGINT AS ba_packets, sum((1-ab)*v)::BIGINT AS ba_bytes FROM s GROUP BY user_id, n""")
def flow_table_batch(s, d):
    return flowtable.batch(flowtable.packets_of_events(s.read.parquet(f"{d}/events.parquet"))).select("flow_key", "start", "last", "ab_packets", "ab_bytes", "ba_packets", "ba_bytes")


from loomgraph.plans import more_queries, packet_queries, store_queries  # noqa: E402,F401  add to QUERIES and ORACLES
