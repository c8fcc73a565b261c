"""Further queries over the star-schema tables, with their SQL: routes, interface metrics, packets, workflows, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import flowids, packets, predicates
from loomgraph.functions.predicates import Gt, Lt, Nee, Outside, metadata
from loomgraph.operators import linkers, metrics, rawpackets
from loomgraph.plans import mutation, rules, topology, workflows
from loomgraph.plans.queries import g, ids, query
from loomgraph.sources import pcap, star
from loomgraph.sources.store import scratch
from loomgraph.streaming import changes, flowtable

DAY = 86_400_000
#: Epoch ms of the start of the events, and of a slice of ten days in them.
FIRST = 1_704_067_200_000
SLICE_START, SLICE_END = FIRST + 5 * DAY, FIRST + 15 * DAY
NOW = 2_000_000_000_000

# filters and entry steps


@query("SELECT id FROM nodes WHERE siz < 40 AND siz > 10")
def v_outside(s, d):
    return ids(g(s, d).V().Has("Size", Outside(40, 10)))


@query("SELECT id, parent, child FROM edges WHERE id = 'own/nation/7'")
def e_by_id(s, d):
    return g(s, d).E("own/nation/7").df.select("id", "parent", "child")


@query("SELECT count(*) count FROM (SELECT id FROM nodes UNION ALL SELECT id FROM edges)")
def elements(s, d):
    return g(s, d).Elements().agg(F.count(F.lit(1)).alias("count"))


@query("SELECT uuid FROM flows WHERE NOT (app='R' AND abp > 10) AND s <= 880000000000 AND l >= 878000000000")
def flows_active_in(s, d):
    found = g(s, d).Flows()
    other = predicates.not_(predicates.test(found.fields, "Application", "R"), predicates.test(found.fields, "Metric.ABPackets", Gt(10)))
    return found.filter(predicates.and_(other, predicates.active_in(found.fields, 878_000_000_000, 880_000_000_000))).df.select("uuid")


@query("SELECT uuid FROM flows WHERE s >= 878000000000 AND l <= 880000000000 AND app IN ('A','R')")
def flows_included_in(s, d):
    found = g(s, d).Flows()
    inside = predicates.included_in(found.fields, 878_000_000_000, 880_000_000_000)
    return found.filter(predicates.and_(inside, predicates.or_term_string(found.fields, "Application", ["A", "R"]))).df.select("uuid")


@query("SELECT id FROM nodes WHERE typ IN ('part', 'customer') AND (mac IS NULL) AND nam IS NOT NULL")
def v_null(s, d):
    found = g(s, d).V()
    kinds = predicates.or_term_string(found.fields, "Type", ["part", "customer"])
    return ids(found.filter(predicates.and_(kinds, predicates.null(found.fields, "MAC"), predicates.not_null(found.fields, "Name"))))


@query("SELECT uuid FROM flows WHERE s <= 880000000000 AND l >= 879000000000 - 600000")
def context_flows(s, d):
    return g(s, d).Context(880_000_000_000, 1_000_000).Flows().df.select("uuid")


@query("SELECT unnest(['Application','CaptureID','FinishType','L3TrackingID','LayersPath','Last','LastUpdate','Link.A','Link.B','Link.ID','Link.Protocol','Metric.ABBytes','Metric.ABPackets','Metric.BABytes','Metric.BAPackets','Metric.Last','Metric.RTT','Metric.Start','Network.A','Network.B','Network.ID','Network.Protocol','NodeTID','ParentUUID','Start','TrackingID','Transport.A','Transport.B','Transport.ID','Transport.Protocol','UUID']) AS value EXCEPT SELECT 'LastUpdate'")
def flows_keys(s, d):
    return s.createDataFrame([(k,) for k in g(s, d).Flows().Keys()], "value string")


@query("SELECT unnest(['ABBytes','ABPackets','BABytes','BAPackets','Last','Start']) AS value")
def metrics_keys(s, d):
    return s.createDataFrame([(k,) for k in metrics.stored_points(g(s, d)).Keys()], "value string")


@query("SELECT sum(abb)::BIGINT AS sum FROM points")
def metrics_sum_key(s, d):
    return metrics.stored_points(g(s, d)).Sum("ABBytes")


# sockets


@query("SELECT DISTINCT tid AS node, ta AS port FROM flows WHERE tb=100 AND proto='TCP' AND app<>'N'")
def sockets_has(s, d):
    found = g(s, d).V().Has("Type", "host").Sockets().Has("Protocol", "TCP", "Name", Nee("N"))
    return found.df.select(F.col("key").alias("node"), F.col("local_port").alias("port")).distinct()


@query("SELECT ta AS value FROM (SELECT DISTINCT tid, app, na, ta, nb, tb, proto FROM flows WHERE tb=100)")
def sockets_values(s, d):
    return g(s, d).V().Has("Type", "host").Sockets().Values("LocalPort").df.select("value")


# paths

WALKS = """hops AS (SELECT c.id AS start, unnest(CASE WHEN c.nk=0 THEN [c.id, 'nation/0'] ELSE [c.id, 'nation/'||c.nk, 'region/'||n.n_regionkey, 'nation/0'] END) AS id,
 unnest(CASE WHEN c.nk=0 THEN [0,1] ELSE [0,1,2,3] END) AS step FROM nodes c JOIN nation n ON n.n_nationkey=c.nk JOIN nation z ON z.n_nationkey=0 WHERE c.typ='host' AND (c.nk=0 OR n.n_regionkey=z.n_regionkey))"""


def _paths(s, d):
    return g(s, d).V().Has("Type", "host").ShortestPathTo(metadata("Type", "nation", "Key", 0), metadata("RelationType", "ownership"))


@query(f"WITH {WALKS} SELECT start, step, id FROM hops")
def shortest_path_ids(s, d):
    found = _paths(s, d).df
    start = found.filter("step = 0").select("path_id", F.col("id").alias("start"))
    return found.join(start, "path_id").select("start", "step", "id")


@query(f"WITH {WALKS} SELECT DISTINCT id FROM hops")
def path_nodes(s, d):
    return ids(_paths(s, d).Dedup())


@query(f"WITH {WALKS}, n AS (SELECT DISTINCT id FROM hops) SELECT 'node' AS kind, id FROM n UNION ALL SELECT 'edge', edges.id FROM edges JOIN n a ON a.id=edges.parent JOIN n b ON b.id=edges.child")
def path_subgraph(s, d):
    return _paths(s, d).SubGraph().Elements()


# routes and interface metrics


@query("""SELECT 'host/'||s_suppkey AS id,
 CASE WHEN s_suppkey%4=1 THEN '10.9.0.'||(s_suppkey%250) WHEN s_suppkey%4=2 THEN '10.1.1.5' ELSE '10.9.1.'||(s_suppkey%250) END AS ip,
 CASE WHEN s_suppkey%4=1 THEN 'gw-0-'||(s_suppkey%250) WHEN s_suppkey%4=2 THEN '' ELSE 'gw-1-'||(s_suppkey%250) END AS mac,
 CASE WHEN s_suppkey%4=1 THEN 2 WHEN s_suppkey%4=2 THEN 3 ELSE 4 END::BIGINT AS if_index
 FROM supplier WHERE s_suppkey%4 IN (1,2) OR s_suppkey%3<>0""")
def nexthop(s, d):
    return star.routed(s, d).V().Has("Type", "host").NextHop("10.1.1.5")


INTERFACES = f"""intf AS (SELECT 'host/'||s_suppkey AS id, s_suppkey AS k, s_suppkey*10 AS rx, CAST(round(s_acctbal*100) AS BIGINT) AS tx, {FIRST}+1000*(s_suppkey%50) AS s FROM supplier WHERE s_suppkey > 0)"""


@query(f"WITH {INTERFACES} SELECT id AS key, s AS start, s + 60000 AS last, rx AS rx_bytes, tx AS tx_bytes FROM intf")
def node_metrics(s, d):
    return star.routed(s, d).V().Has("Type", "host").Metrics().df.selectExpr("key", "start", "last", "RxBytes as rx_bytes", "TxBytes as tx_bytes")


@query(f"WITH {INTERFACES} SELECT id AS key, s AS start FROM intf WHERE s > {FIRST} + 2000 AND s + 60000 < {FIRST} + 100000")
def node_metrics_slice(s, d):
    return star.routed(s, d).Context(FIRST + 100_000, 98).V().Has("Type", "host").Metrics().df.select("key", "start")


@query(f"WITH {INTERFACES} SELECT sum(rx)::BIGINT AS rx_bytes, sum(tx)::BIGINT AS tx_bytes, min(s) AS start, max(s) + 60000 AS last FROM intf")
def node_metrics_sum(s, d):
    return star.routed(s, d).V().Has("Type", "host").Metrics().Sum().selectExpr("RxBytes as rx_bytes", "TxBytes as tx_bytes", "start", "last")


@query("SELECT 'host/'||s_suppkey AS id FROM supplier WHERE s_suppkey*10 > 20 AND s_suppkey%50 < 20")
def value_has(s, d):
    found = star.routed(s, d).V().Has("Type", "host").Values("LastUpdateMetric").Has("RxBytes", Gt(20), "Start", Lt(FIRST + 20_000))
    return found.df.select(F.col("_pos").alias("id"))


@query("SELECT 'host/'||s_suppkey AS id, 'host/'||(s_suppkey//2) AS next, 1500-100*(s_suppkey%3) AS before, 1500-100*((s_suppkey//2)%3) AS mtu FROM supplier WHERE s_suppkey BETWEEN 2 AND 3 AND (s_suppkey//2)%3 > s_suppkey%3")
def workflow_check_mtu(s, d):
    found = workflows.run(star.routed(s, d), "check_mtu", metadata("Level", 1), metadata("Type", "host", "Key", 1))
    return found.select(F.concat(F.lit("host/"), F.col("path_id").cast("string")).alias("_p"), F.col("id").alias("next"), "mtu", "before").join(
        star.routed(s, d).V().Has("Level", 1).df.select("id", (1500 - 100 * (F.col("metadata.Key") % 3)).alias("_b")), F.col("before") == F.col("_b")).select("id", "next", "before", "mtu")


@query("WITH l(k, n) AS (SELECT s_suppkey, CAST(floor(log2(s_suppkey)+1e-9) AS INT) FROM supplier WHERE s_suppkey > 0) SELECT 'host/'||k AS id, n AS hops FROM l WHERE n > 0")
def workflow_check_connectivity(s, d):
    found = workflows.run(star.routed(s, d), "check_connectivity", metadata("Type", "host"), metadata("Type", "host", "Key", 1))
    return found.filter("hops > 0").select("id", "hops")


@query("SELECT DISTINCT a.tid AS client_node, b.tid AS server_node, 100::BIGINT AS port FROM flows a JOIN flows b ON a.tb=100 AND b.tb=100 AND b.na=a.nb AND b.ta=a.tb AND b.nb=a.na AND b.tb=a.ta AND a.proto=b.proto WHERE a.tid<>b.tid UNION SELECT DISTINCT tid, 'peer/'||nb, 100 FROM flows WHERE tb=100 AND ta>=100")
def workflow_flow_matrix(s, d):
    graph = g(s, d)
    turned = graph.sockets.selectExpr("concat('peer/', remote_address) as node_id", "process", "pid", "name", "remote_address as local_address", "remote_port as local_port", "local_address as remote_address", "local_port as remote_port", "protocol", "state")
    graph.sockets = graph.sockets.unionByName(turned)
    return workflows.run(graph, "flow_matrix").filter("port = 100").select("client_node", "server_node", "port").distinct()


@query("SELECT track AS tracking_id, count(*) AS captures, min(n)::BIGINT AS least, max(n)::BIGINT AS most FROM (SELECT track, tid, sum(abb+bab) n FROM flows GROUP BY track, tid) GROUP BY track HAVING min(n)<>max(n)")
def workflow_flow_validation(s, d):
    return workflows.run(g(s, d), "flow_validation")


@query("SELECT id FROM nodes WHERE typ='host' AND nk=3")
def workflow_captures(s, d):
    return workflows.run(g(s, d), "captures", "NationKey", 3)


# flow metrics in a slice, and the algebra

USERS = "users AS (SELECT k, min(s) s0, max(l) l0 FROM points GROUP BY k)"


@query(f"WITH {USERS} SELECT points.k AS key, s AS start, l AS last, abp AS ab_packets FROM points JOIN users USING (k) WHERE s >= {SLICE_START} AND l <= {SLICE_END} AND s0 <= {SLICE_END} AND l0 >= {SLICE_START} - 600000 AND CAST(k AS BIGINT) % 2 = 0")
def flow_metrics_slice(s, d):
    graph = star.users(s, d).Context(SLICE_END, (SLICE_END - SLICE_START) // 1000)
    return graph.Flows("Application", "even").Metrics().df.select("key", "start", "last", "ab_packets")


@query(f"""WITH cut AS (SELECT *, {FIRST} + 10*{DAY} AS c FROM points), r AS (SELECT *, (c-s)::DOUBLE/(l-s) AS q FROM cut)
SELECT k AS key, s AS start, CASE WHEN c <= s THEN NULL WHEN c >= l OR s = l THEN abp ELSE CAST(trunc(abp*q) AS BIGINT) END AS before,
 CASE WHEN c <= s THEN abp WHEN c >= l OR s = l THEN NULL ELSE abp - CAST(trunc(abp*q) AS BIGINT) END AS after FROM r""")
def metrics_split(s, d):
    points = g(s, d).flow_metrics.withColumn("m", F.struct(*metrics.COUNTERS, "start", "last"))
    parts = points.withColumn("p", metrics.split(F.col("m"), F.lit(FIRST + 10 * DAY)))
    return parts.select(F.col("flow_uuid").alias("key"), "start", F.col("p.before.ab_packets").alias("before"), F.col("p.after.ab_packets").alias("after"))


@query("SELECT uuid, abp - bap AS packets, abb - bab AS bytes, abp = 0 AND abb = 0 AND bap = 0 AND bab = 0 AS zero FROM flows WHERE app='R'")
def metrics_algebra(s, d):
    turned = F.struct(F.col("metric.ba_packets").alias("ab_packets"), F.col("metric.ba_bytes").alias("ab_bytes"), F.lit(0).cast("long").alias("ba_packets"), F.lit(0).cast("long").alias("ba_bytes"), F.col("metric.start").alias("start"), F.col("metric.last").alias("last"))
    found = g(s, d).Flows("Application", "R").df.withColumns({"t": turned})
    found = found.withColumn("x", metrics.sub(metrics.add(F.col("metric"), F.col("t")), F.col("t"))).withColumn("y", metrics.sub(F.col("x"), F.col("t")))
    return found.select("uuid", F.col("y.ab_packets").alias("packets"), F.col("y.ab_bytes").alias("bytes"), metrics.is_zero(F.col("x")).alias("zero"))


# packets


@query("SELECT uuid FROM flows WHERE proto='TCP' AND (tb=100 OR tb=300) AND NOT (nb LIKE '10.1.0.%' AND split_part(nb,'.',4)::INT < 128)")
def bpf(s, d):
    found = star.with_packets(s, d).Flows().RawPackets().BPF("tcp and (dst port 100 or dst port 300) and not dst net 10.1.0.0/25")
    return found.df.select(F.col("flow_uuid").alias("uuid"))


@query("SELECT uuid, na AS network_a, nb AS network_b, proto AS protocol, ta AS transport_a, tb AS transport_b FROM flows")
def packets_decoded(s, d):
    return packets.decoded(star.with_packets(s, d).raw_packets).select(F.col("flow_uuid").alias("uuid"), "network_a", "network_b", "protocol", "transport_a", "transport_b")


#: Packets of each flow by direction.
OF_PACKETS = """WITH p AS (SELECT least(na,nb) a, greatest(na,nb) b, na <= nb AS f, proto, CASE WHEN na<=nb THEN ta ELSE tb END pa, CASE WHEN na<=nb THEN tb ELSE ta END pb, s FROM flows)
SELECT a||'/'||b||'/'||proto||'/'||pa||'/'||pb AS flow_key, sum(f::INT)::BIGINT AS ab_packets, sum(1-f::INT)::BIGINT AS ba_packets FROM p GROUP BY 1"""


@query(OF_PACKETS)
def flow_table_of_packets(s, d):
    star.dealt(s, d, "lineitem", "orders")
    return _by_direction(star.with_packets(s, d).raw_packets)


def _by_direction(raw):
    return flowtable.batch(packets.rows(raw, mode="L3")).groupBy("flow_key").agg(F.sum("ab_packets").alias("ab_packets"), F.sum("ba_packets").alias("ba_packets"))


@query(OF_PACKETS)
def flow_table_of_captures(s, d):
    """The same packets written to capture files and replayed from them."""
    star.dealt(s, d, "lineitem", "orders")
    folder = scratch(s, "captures")
    pcap.save(star.with_packets(s, d).raw_packets, folder)
    return _by_direction(pcap.read(s, folder))


EVENTS = """e AS (SELECT user_id::VARCHAR k, (epoch_us(ts)//1000) t, CAST(round(value*100) AS BIGINT) v, event_type IN ('view','click') ab,
 CASE event_type WHEN 'view' THEN 'SYN' WHEN 'click' THEN 'FIN' WHEN 'purchase' THEN 'SYN|ACK' ELSE 'RST' END f FROM events)"""


def _flagged(s, d):
    rows = flowtable.packets_of_events(s.read.parquet(f"{d}/events.parquet").withColumn("value", F.col("value")))
    kind = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("flow_key"), F.expr(star.ms("ts")).alias("at"), "event_type")
    flags = F.when(F.col("event_type") == "view", "SYN").when(F.col("event_type") == "click", "FIN").when(F.col("event_type") == "purchase", "SYN|ACK").otherwise("RST")
    return rows.join(kind.select("flow_key", "at", flags.alias("flags")), ["flow_key", "at"])


@query(f"""WITH {EVENTS} SELECT k AS flow_key, min(t) FILTER (ab AND contains(f,'SYN')) AS ab_syn_start, min(t) FILTER (ab AND contains(f,'FIN')) AS ab_fin_start,
 min(t) FILTER (NOT ab AND contains(f,'SYN')) AS ba_syn_start, min(t) FILTER (NOT ab AND contains(f,'RST')) AS ba_rst_start,
 CASE WHEN min(t) FILTER (NOT ab AND f='SYN|ACK') >= min(t) FILTER (ab AND f='SYN') THEN 1000000*(min(t) FILTER (NOT ab AND f='SYN|ACK') - min(t) FILTER (ab AND f='SYN')) END AS rtt FROM e GROUP BY k""")
def tcp_metrics(s, d):
    return flowtable.tcp_metrics(_flagged(s, d)).select("flow_key", "ab_syn_start", "ab_fin_start", "ba_syn_start", "ba_rst_start", "rtt")


@query(f"WITH {EVENTS} SELECT k AS flow_key, t//60000*60000 AS start, t//60000*60000+60000 AS last, sum(ab::INT)::BIGINT AS ab_packets, sum(CASE WHEN ab THEN v ELSE 0 END)::BIGINT AS ab_bytes, sum(1-ab::INT)::BIGINT AS ba_packets, sum(CASE WHEN ab THEN 0 ELSE v END)::BIGINT AS ba_bytes FROM e GROUP BY k, t//60000")
def flow_updates(s, d):
    return flowtable.updates(flowtable.packets_of_events(s.read.parquet(f"{d}/events.parquet")))


#: With days in place of minutes, as events are hours apart: flows that begin with FIN or RST are held for eight hours.
@query("""WITH e AS (SELECT user_id u, (epoch_us(ts)//1000) t, event_type IN ('click', 'error') AS fin, (epoch_us(ts)//1000) - lag((epoch_us(ts)//1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts)//1000), event_type) gap,
 event_type FROM events), a AS (SELECT *, coalesce(gap > 86400000, true) AS idle, coalesce(gap >= 28800000, true) AS pause FROM e),
b AS (SELECT *, sum(idle::INT) OVER (PARTITION BY u ORDER BY t, event_type ROWS UNBOUNDED PRECEDING) AS span FROM a),
c AS (SELECT u, span, min(t) FILTER (NOT fin AND (idle OR pause)) AS lasting FROM b GROUP BY u, span),
d AS (SELECT u, t, fin, event_type, sum((idle OR (pause AND (lasting IS NULL OR t <= lasting)))::INT) OVER (PARTITION BY u ORDER BY t, event_type ROWS UNBOUNDED PRECEDING) AS n FROM b JOIN c USING (u, span))
SELECT u::VARCHAR AS flow_key, min(t) AS start, max(t) AS last, count(*) AS packets,
 CASE arg_min(event_type, t) WHEN 'click' THEN 'TCP_FIN' WHEN 'error' THEN 'TCP_RST' ELSE 'TIMEOUT' END AS finish_type FROM d GROUP BY u, n""")
def flow_table_held(s, d):
    events = s.read.parquet(f"{d}/events.parquet")
    flags = F.when(F.col("event_type") == "click", "FIN|ACK").when(F.col("event_type") == "error", "RST").otherwise("ACK")
    rows = events.select(F.col("user_id").cast("string").alias("flow_key"), F.lit("AB").alias("direction"), F.expr(star.ms("ts")).alias("at"), F.lit(1).cast("long").alias("bytes"), flags.alias("flags"))
    return flowtable.batch(rows, expire=DAY, hold=DAY // 3).select("flow_key", "start", "last", F.col("ab_packets").alias("packets"), "finish_type")


@query("""WITH e AS (SELECT user_id k, (epoch_us(ts)//1000) t, event_type = 'view' AS ask FROM events WHERE event_type IN ('view', 'click')),
 n AS (SELECT *, coalesce(sum((NOT ask)::INT) OVER (PARTITION BY k ORDER BY t, NOT ask ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS trip FROM e)
SELECT k::VARCHAR AS flow_key, 1000000*min(t) FILTER (ask) AS asked, 1000000*max(t) FILTER (NOT ask) AS answered, 1000000*(max(t) FILTER (NOT ask) - min(t) FILTER (ask)) AS rtt
 FROM n GROUP BY k, trip HAVING count(*) FILTER (ask) > 0 AND count(*) FILTER (NOT ask) > 0""")
def round_trips(s, d):
    events = s.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "view", flowtable.ECHO[0]).when(F.col("event_type") == "click", flowtable.ECHO_REPLY[0])
    return flowtable.round_trips(events.select(F.col("user_id").cast("string").alias("flow_key"), F.expr(star.ms("ts")).alias("at"), F.lit("ICMP").alias("protocol"), kind.alias("icmp_type")))


@query("""SELECT user_id::VARCHAR AS flow_uuid, (epoch_us(ts)//1000) AS timestamp, row_number() OVER w AS index FROM events WINDOW w AS (PARTITION BY user_id ORDER BY (epoch_us(ts)//1000), event_id) QUALIFY row_number() OVER w <= 10""")
def packets_captured(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("flow_uuid"), F.expr(star.ms("ts")).alias("timestamp"), F.col("event_id").alias("index"))
    return rawpackets.captured(rows)


@query("SELECT uuid, CASE WHEN ta IN (1030, 1040) THEN 'ALPHA' WHEN tb=100 THEN 'BETA' WHEN tb=200 THEN 'GAMMA' END AS name FROM flows")
def application_of_ports(s, d):
    name = flowids.application(F.col("transport.a"), F.col("transport.b"), {1030: "alpha", 1040: "alpha", 100: "beta", 200: "gamma"})
    return g(s, d).Flows().df.select("uuid", name.alias("name"))


# ids


@query("SELECT id, CASE WHEN typ='host' THEN tid END AS tid FROM nodes WHERE typ='host'")
def topology_ids_known(s, d):
    return topology.topology_ids(g(s, d)).filter("id like 'host/%'")


@query("SELECT parent, child, min(id) AS id FROM edges WHERE rel='layer2' AND parent IN ('host/1','host/2') GROUP BY parent, child")
def first_links(s, d):
    graph = g(s, d)
    pairs = graph.E().df.filter("parent in ('host/1', 'host/2')").select("parent", "child").filter("child like 'part/%'")
    return linkers.first_links(graph, pairs)


# revisions of orders


@query(f"SELECT id, 1::BIGINT AS revision, CASE WHEN nk=1 THEN {NOW} END AS archived_at FROM nodes WHERE typ='customer' UNION ALL SELECT id, 2, NULL FROM nodes WHERE typ='customer' AND nk=1")
def mutation_update(s, d):
    log = g(s, d).nodes.filter("metadata.Type = 'customer'")
    new = log.filter("metadata.NationKey = 1").select("id", mutation.with_fields("metadata", Segment=F.lit("moved")).alias("metadata"))
    same = log.filter("metadata.NationKey = 2").select("id", "metadata")
    return mutation.update(log, new.unionByName(same), NOW).select("id", "revision", "archived_at")


@query(f"SELECT 'node' AS kind, id FROM nodes WHERE typ<>'nation' OR k<>3 UNION ALL SELECT 'edge', id FROM edges WHERE parent<>'nation/3' AND child<>'nation/3'")
def mutation_delete_nodes(s, d):
    graph = g(s, d)
    nodes, edges = mutation.delete_nodes(graph, graph.V().Has("Type", "nation", "Key", 3).df.select("id"), NOW)
    graph.nodes, graph.edges = nodes, edges
    return graph.Elements()


@query("SELECT id, revision FROM (SELECT id, 1::BIGINT AS revision FROM nodes WHERE typ IN ('nation','region') UNION ALL SELECT 'new/'||k, 1 FROM nodes WHERE typ='nation')")
def mutation_insert(s, d):
    log = g(s, d).nodes.filter("metadata.Type in ('nation', 'region')")
    nations = log.filter("metadata.Type = 'nation'")
    rows = nations.select(F.concat(F.lit("new/"), F.col("metadata.Key").cast("string")).alias("id"), "metadata").unionByName(nations.select("id", "metadata"))
    return mutation.insert(log, mutation.added(rows, NOW)).select("id", "revision")


@query("SELECT id, CASE WHEN k%2=0 THEN 5 ELSE 1 END::BIGINT AS revision FROM nodes WHERE typ='host'")
def mutation_merge(s, d):
    log = g(s, d).nodes.filter("metadata.Type = 'host'")
    newer = log.filter("metadata.Key % 2 = 0").withColumns({"revision": F.lit(5).cast("long"), "updated_at": F.lit(NOW)})
    older = log.filter("metadata.Key % 2 = 1").withColumn("revision", F.lit(0).cast("long"))
    return mutation.merge(log, newer.unionByName(older)).filter("archived_at is null").select("id", "revision")


@query(f"SELECT id, 1::BIGINT AS revision, seg AS segment, CASE WHEN nk < 5 THEN {NOW} END AS archived_at FROM nodes WHERE typ='customer' UNION ALL SELECT id, 2, 'ruled', NULL FROM nodes WHERE typ='customer' AND nk < 5")
def rules_update(s, d):
    graph = g(s, d)
    found = graph.V().Has("Type", "customer", "NationKey", Lt(5))
    log = rules.update(found, NOW, Segment=F.lit("ruled")).filter("metadata.Type = 'customer'")
    return log.select("id", "revision", F.col("metadata.Segment").alias("segment"), "archived_at")


@query("SELECT id, k%3<>0 AS live FROM nodes WHERE typ='host'")
def mutation_sync(s, d):
    log = g(s, d).nodes.filter("metadata.Type = 'host'")
    return mutation.synced(log, "star", log.filter("metadata.Key % 3 <> 0"), NOW).select("id", F.col("archived_at").isNull().alias("live"))


@query("SELECT id FROM edges WHERE rel='layer2' AND NOT parent='host/1'")
def mutation_unlink(s, d):
    graph = g(s, d)
    pairs = graph.E().Has("RelationType", "layer2", "Parent", "host/1").df.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return mutation.unlink(graph, pairs, NOW).filter("archived_at is null and metadata.RelationType = 'layer2'").select("id")


#: An order is added, finished orders are deleted after ten days, and pending ones are added again after twenty.
@query(f"""SELECT 'order/'||o_orderkey AS id, epoch_ms(o_orderdate) AS created_at, CASE WHEN o_orderstatus IN ('F','P') THEN epoch_ms(o_orderdate)+10*{DAY} END AS deleted_at FROM orders
UNION ALL SELECT 'order/'||o_orderkey, epoch_ms(o_orderdate)+20*{DAY}, NULL FROM orders WHERE o_orderstatus='P'""")
def changes_revisions(s, d):
    star.dealt(s, d, "orders")
    rows, at = s.read.parquet(f"{d}/orders.parquet"), star.ms("o_orderdate")
    change = lambda rows, op, after, revision: rows.selectExpr(
        f"'{op}' as op", "'node' as kind", "concat('order/', cast(o_orderkey as string)) as id", "cast(null as string) as parent", "cast(null as string) as child",
        f"{at} + {after} * {DAY}L as at", f"{revision}L as revision", "'{}' as metadata")
    log = change(rows, "add", 0, 1).unionByName(change(rows.filter("o_orderstatus in ('F', 'P')"), "delete", 10, 2)).unionByName(change(rows.filter("o_orderstatus = 'P'"), "add", 20, 1))
    return changes.revisions(log).select("id", "created_at", "deleted_at")
