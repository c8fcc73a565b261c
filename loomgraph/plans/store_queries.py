"""Queries of graphs that were stored, changed and read again, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.plans import mutation, topology
from loomgraph.plans.queries import query
from loomgraph.sources import star
from loomgraph.sources.history import History
from loomgraph.sources.store import scratch

DAY = 86_400_000
NOW = 2_000_000_000_000
#: An instant among the orders' dates.
POINT = 880_000_000_000

#: Orders begin as NEW at their date and get their status 30 days later; pending ones are deleted at NOW, and urgent ones of them added again.
ORDERS = f"""o AS (SELECT 'order/'||o_orderkey AS id, epoch_ms(o_orderdate) AS t, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
log AS (SELECT id, t AS created, t AS updated, NULL::BIGINT AS deleted, t+{30 * DAY} AS archived, 1 AS revision, 'NEW' AS status FROM o
 UNION ALL SELECT id, t, t+{30 * DAY}, CASE WHEN st='P' THEN {NOW} END, CASE WHEN st='P' THEN {NOW} END, 2, st FROM o
 UNION ALL SELECT id, {NOW + DAY}, {NOW + DAY}, NULL, NULL, 1, 'AGAIN' FROM o WHERE st='P' AND pr='1-URGENT')"""


def _changed(s, d) -> History:
    star.dealt(s, d, "orders")
    history = History(s, scratch(s, "orders"), folder_days=256)
    log = star.history(s, d).nodes
    history.put(log.filter("revision = 1").withColumn("archived_at", F.lit(None).cast("long")))
    history.put(log.filter("revision = 2"))  # closes the first revisions
    pending = history.live().filter("metadata.Status = 'P'").select("id")
    history.change(pending, lambda live: mutation.delete(live, pending, NOW))
    rows = s.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    again = rows.selectExpr("concat('order/', cast(o_orderkey as string)) as id").join(log.filter("revision = 1").select("id", "metadata"), "id")
    again = again.withColumn("metadata", mutation.with_fields("metadata", Status=F.lit("AGAIN")))
    history.put(mutation.insert(history.live(), mutation.added(again, NOW + DAY)).filter(F.col("created_at") == NOW + DAY))
    return history


@query(f"WITH {ORDERS} SELECT id, created AS created_at, revision::BIGINT AS revision, status FROM log WHERE archived IS NULL")
def store_live(s, d):
    return _changed(s, d).live().select("id", "created_at", "revision", F.col("metadata.Status").alias("status"))


@query(f"WITH {ORDERS} SELECT id, created AS created_at, updated AS updated_at, deleted AS deleted_at, archived AS archived_at, revision::BIGINT AS revision, status FROM log")
def store_log(s, d):
    return _changed(s, d).log().select("id", "created_at", "updated_at", "deleted_at", "archived_at", "revision", F.col("metadata.Status").alias("status"))


@query(f"WITH {ORDERS} SELECT id, max(revision)::BIGINT AS revision FROM log WHERE updated <= {POINT} AND (archived IS NULL OR archived >= {POINT}) GROUP BY id")
def store_at(s, d):
    history = _changed(s, d)
    base = star.graph(s, d)
    base.nodes, base.prune = history.live(), lambda table, slice_: history.slice(slice_.start, slice_.last)
    return base.Context(POINT).V().df.select("id", "revision")


@query(f"""SELECT id, 2::BIGINT AS revision, CASE WHEN siz >= 25 THEN '{{"Large":true,"Size":'||siz||'}}' ELSE '{{"Size":'||siz||'}}' END AS box, 1::BIGINT AS tags, false AS branded FROM nodes WHERE typ='part'
UNION ALL SELECT id, 1, NULL, NULL, NULL FROM nodes WHERE typ<>'part'""")
def metadata_edits(s, d):
    """Parts of a graph with open metadata get a box and a tag and lose their brand; large ones are marked in a second set of edits of the same revision time."""
    star.dealt(s, d, "customer", "supplier", "part", "orders")
    log = star.graph(s, d).nodes.withColumn("metadata", F.parse_json(F.to_json("metadata")))
    parts = log.filter("try_variant_get(metadata, '$.Type', 'string') = 'part'")
    size = F.expr("try_variant_get(metadata, '$.Size', 'bigint')")
    mark = F.when(size >= 25, True)
    log = mutation.edit(log, parts, NOW, ("set", "Box.Size", size), ("set", "Box.Large", mark), ("append", "Tags", "boxed"), ("delete", "Brand"))
    get = lambda path, kind: F.try_variant_get("metadata", path, kind)
    box = F.map_filter(get("$.Box", "map<string,string>"), lambda k, v: v.isNotNull())
    text = F.when(box.isNotNull(), F.concat(F.lit("{"), F.when(F.map_contains_key(box, "Large"), F.lit('"Large":true,')).otherwise(""), F.lit('"Size":'), F.try_element_at(box, F.lit("Size")), F.lit("}")))
    return log.filter("archived_at is null").select("id", "revision", text.alias("box"), F.size(get("$.Tags", "array<variant>")).cast("long").alias("tags"), F.when(text.isNotNull(), get("$.Brand", "string").isNotNull()).alias("branded"))


def _uuid5(text: str, rows: str) -> str:
    """SQL that gives (id, tid, typ, nam) with tid as the name-based UUID (version 5) of a text of *rows*."""
    h = f"sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({text}))"
    return f"SELECT id, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', (('0x'||substr(h,17,1))::INT & 3) + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS tid FROM (SELECT *, {h} AS h FROM {rows})"


#: Regions are given ids; what they own is named by its owner's id, its name and its type, down to the customers.
@query(f"""WITH top AS (SELECT id, 'root/'||id AS tid FROM nodes WHERE typ='region'),
 second AS ({_uuid5("owner || nam || typ", "(SELECT nodes.id, nam, typ, top.tid AS owner FROM nodes JOIN edges ON child = nodes.id JOIN top ON top.id = parent WHERE typ = 'nation')")}),
 third AS ({_uuid5("owner || nam || typ", "(SELECT nodes.id, nam, typ, second.tid AS owner FROM nodes JOIN edges ON child = nodes.id JOIN second ON second.id = parent WHERE typ = 'customer')")})
SELECT * FROM top UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third UNION ALL SELECT id, tid FROM nodes WHERE typ='host'""")
def topology_ids_owned(s, d):
    graph = star.graph(s, d)
    root = F.when(F.col("metadata.Type") == "region", F.concat(F.lit("root/"), F.col("id"))).otherwise(F.col("metadata.TID"))
    graph.nodes = graph.nodes.withColumn("metadata", F.col("metadata").withField("TID", root))
    return topology.topology_ids(graph)
