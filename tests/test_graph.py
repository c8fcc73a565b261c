"""Steps on a small graph of routers with open metadata."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.predicates import Between, Gt, Gte, Inside, Ipv4Range, Lt, Lte, Ne, Nee, Outside, Regex, Within, Without, metadata
from loomgraph.plans.graph import Graph

NODES = {
    "alpha": {"Rank": 10, "Kind": "router", "Load": 70, "Tags": ["x", "y"], "Inner": {"depth": 3}},
    "beta": {"Rank": 20, "Kind": "router", "Load": 35, "IPV4": ["172.16.4.9", "172.16.5.1"]},
    "gamma": {"Rank": 30, "Kind": "tap", "IPV4": "172.20.0.130/25", "Inner": {}},
    "delta": {"Rank": 40, "Label": "Delta-7", "Load": 5, "IPV4": "172.20.9.1", "Slots": [7, 8, 9], "MTU": 9000},
    "omega": {"Rank": 50, "Label": "Omega-1"},
}
EDGES = [("a", "alpha", "beta", {"Side": "up"}), ("b", "beta", "gamma", {"Side": "up"}), ("c", "gamma", "delta", {}), ("d", "delta", "omega", {"Side": "down"}), ("e", "alpha", "gamma", {"Mode": "fast"}), ("f", "omega", "alpha", {})]
BASE = "host string, origin string, created_at long, updated_at long, deleted_at long, archived_at long, revision long, m string"


def build(spark, nodes, edges):
    base = ("h", "o", 0, 0, None, None, 1)
    n = spark.createDataFrame([(k, *base, json.dumps(v)) for k, v in nodes.items()], "id string, " + BASE)
    e = spark.createDataFrame([(i, p, c, *base, json.dumps(m)) for i, p, c, m in edges], "id string, parent string, child string, " + BASE)
    return Graph(n.withColumn("metadata", F.parse_json("m")).drop("m"), e.withColumn("metadata", F.parse_json("m")).drop("m"))


@pytest.fixture(scope="module")
def graph(spark):
    return build(spark, NODES, [(i, p, c, m | {"Name": i}) for i, p, c, m in EDGES])


def n(found):
    return found.Count().first()["count"]


def ids(found):
    return sorted(r["id"] for r in found.df.select("id").collect())


@pytest.mark.parametrize(
    "args, expected",
    [
        (("Rank", 10), 1), (("Kind", "router"), 2), (("Tags", "x"), 1), (("Slots", 8), 1), (("Kind",), 3),
        (("Rank", Within(10, 20, 50)), 3), (("Rank", Without(10, 30)), 3), (("Rank", Lt(30)), 2), (("Rank", Gt(30)), 2), (("Rank", Lte(30)), 3), (("Rank", Gte(30)), 3),
        (("Rank", Inside(10, 40)), 2), (("Rank", Between(10, 40)), 3), (("Rank", Outside(10, 40)), 0), (("Rank", Outside(45, 15)), 3),
        (("Rank", Ne(10)), 4), (("MTU", Ne(1500)), 1), (("MTU", Ne("")), 1), (("MTU", Ne(9000)), 0), (("Absent", Ne(1)), 0),
        (("Rank", Nee(10)), 4), (("MTU", Nee(1500)), 5), (("MTU", Nee("")), 5), (("MTU", Nee(9000)), 4), (("Absent", Nee(1)), 5),
        (("IPV4", Ipv4Range("172.20.0.128/25")), 1), (("IPV4", Ipv4Range("172.20.0.0/16")), 2), (("IPV4", Ipv4Range("172.16.4.0/23")), 1), (("IPV4", Ipv4Range("172.20.0.0/26")), 0),
        (("Label", Regex("Delta.*")), 1), (("IPV4", Regex("172.16.*")), 1), (("@ID", "gamma"), 1), (("Inner.depth", 3), 1), (("Metadata.Rank", 20), 1),
    ],
)
def test_has(graph, args, expected):
    assert n(graph.V().Has(*args)) == expected


def test_has_errors(graph):
    with pytest.raises(ValueError):
        graph.V().Has("Kind", "tap", "odd")
    with pytest.raises(ValueError):
        Regex("^a")
    with pytest.raises(LookupError):
        graph.V("nobody")


def test_keys_and_either(graph):
    v = graph.V()
    assert n(v.HasEither("Kind", "router", "Label", "Delta-7")) == 3
    assert (n(v.HasKey("Label")), n(v.HasKey("Unknown")), n(v.HasNot("Label"))) == (2, 0, 3)
    own = {"Rank", "Kind", "Load", "Tags", "Inner", "Inner.depth", "IPV4", "Label", "Slots", "MTU"}
    keys = [r["value"] for r in v.Keys().df.collect()]
    assert len(keys) == 7 + len(own) and {k for k in keys if not k.startswith("@")} == own
    assert n(v.Values("Kind")) == 3 and n(v.Values("Inner")) == 1
    assert v.Sum("Load").first()["sum"] == 110
    assert n(v.ValueMap("Label", "MTU")) == 2
    assert n(v.Values("Kind").Dedup()) == 2
    with pytest.raises(Exception, match="isn't a number"):
        v.Sum("Kind").collect()


def test_walk(graph):
    found = graph.V().Has("Rank", 10).Out().Has("Rank", 20).OutE().Has("Side", "up").OutV().Out()
    assert ids(found) == ["delta"]
    assert n(graph.V().Has("Rank", 30).BothE()) == 3
    assert ids(graph.V().Has("Rank", 10).OutE().Has("Mode", "fast").OutV()) == ["gamma"]
    assert ids(graph.V().Has("Rank", 30).In()) == ["alpha", "beta"]
    assert ids(graph.V().Has("Rank", 30).Both()) == ["alpha", "beta", "delta"]
    assert ids(graph.E().Has("Side", "up").InV()) == ["alpha", "beta"]
    assert ids(graph.E("d").BothV()) == ["delta", "omega"]
    assert n(graph.E().Has("Name", "d")) == 1


def test_paths(graph):
    target = metadata("Rank", 40)
    one = graph.V().Has("Rank", 10).ShortestPathTo(target)
    assert [r["id"] for r in one.df.orderBy("step").collect()] == ["alpha", "gamma", "delta"]  # the smaller of two equal ways
    assert one.Count().first()["count"] == 1
    assert graph.V().Has("Rank", Within(10, 20)).ShortestPathTo(target).Count().first()["count"] == 2
    up = graph.V().Has("Rank", 10).ShortestPathTo(metadata("Rank", 30), metadata("Side", "up"))
    assert [r["id"] for r in up.df.orderBy("step").collect()] == ["alpha", "beta", "gamma"]
    assert graph.V().Has("Rank", 10).ShortestPathTo(metadata("Rank", 99)).Count().first()["count"] == 0
    twice = graph.V().Has("Rank", 20).As("x").Select("x", "x").ShortestPathTo(target)
    assert twice.Count().first()["count"] == 2 and twice.df.count() == 6


def test_subgraph_select_order(graph):
    sub = graph.V().Has("Rank", Within(10, 20, 30)).SubGraph()
    assert (ids(sub.V()), ids(sub.E())) == (["alpha", "beta", "gamma"], ["a", "b", "e"])
    assert ids(graph.V().Has("Rank", Within(10, 20, 30)).SubGraph("Side", "up").E()) == ["a", "b"]
    graph.V().Has("Rank", 10).As("a").G().V().Has("Rank", 20).As("b")
    assert ids(graph.V().Select("a", "b")) == ["alpha", "beta"]
    assert [r["id"] for r in graph.V().Sort("DESC", "Rank").Limit(2).df.collect()] == ["omega", "delta"]
    assert [r["id"] for r in graph.V().Sort("Rank").Range(1, 3).df.collect()] == ["beta", "gamma"]
    assert sub.Diff(graph).count() == 5


def test_dedup(spark):
    rows = {"p": {"Owner": "red", "Kind": "a", "Slot": 4}, "q": {"Owner": "blue", "Kind": "a", "Slot": 4}, "r": {"Owner": "red", "Kind": "b"}, "s": {"Kind": "a"}, "t": {"Note": "none"}}
    v = build(spark, rows, [("e", "p", "q", {})]).V()
    assert [n(v.Dedup(*k)) for k in (("Kind",), ("Owner", "Kind"), ("Slot",), ("Misc", "Slot"))] == [3, 5, 4, 4]


def test_reach(spark):
    own = {"RelationType": "ownership"}
    g = build(spark, {x: {} for x in "abcde"}, [("1", "a", "b", own), ("2", "b", "c", own), ("3", "c", "a", own), ("4", "c", "d", {"RelationType": "layer2"}), ("5", "e", "e", own)])
    assert ids(g.V("a").Descendants()) == ["a", "b"]
    assert ids(g.V("a").Descendants(0)) == ["a", "b", "c"]  # a cycle ends
    assert ids(g.V("b").Ascendants()) == ["a", "b"]
    assert ids(g.V("d").Neighbors()) == ["c", "d"] and ids(g.V("d").Neighbors(0)) == ["d"] and ids(g.V("d").Neighbors(2)) == ["a", "b", "c", "d"]
    assert ids(g.V("e").Both()) == ["e"] and ids(g.V("e").BothE()) == ["5"]


def test_context(spark):
    from pyspark.sql import Row

    rows = [Row(id="aaa", host="", origin="", created_at=1000, updated_at=1000, deleted_at=None, archived_at=2000, revision=1, metadata=Row(MTU=1500)),
            Row(id="aaa", host="", origin="", created_at=1000, updated_at=2000, deleted_at=None, archived_at=None, revision=2, metadata=Row(MTU=1510))]
    nodes = spark.createDataFrame(rows, "id string, host string, origin string, created_at long, updated_at long, deleted_at long, archived_at long, revision long, metadata struct<MTU:long>")
    g = Graph(nodes, nodes.limit(0))
    assert [r["revision"] for r in g.V().df.collect()] == [2]
    assert [r["revision"] for r in g.Context(1).V().df.collect()] == [1]
    assert [r["revision"] for r in g.Context(3).V().df.collect()] == [2]
    assert sorted(r["revision"] for r in g.Context("-1s", "2s", now_ms=4000).V().df.collect()) == [1, 2]
    assert g.Context("Thu, 01 Jan 1970 00:00:03 GMT").slice.last == 3000
    with pytest.raises(ValueError):
        Graph(nodes, nodes, history=False).Context(1)
