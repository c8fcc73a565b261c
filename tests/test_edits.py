"""Edits of open metadata against Python dictionaries."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import edits
from loomgraph.plans import mutation
from loomgraph.plans.graph import Graph


def plain(data, ops):
    data = copy.deepcopy(data)
    for name, path, *value in ops:
        *way, last = path.split(".")
        at, trail = data, []
        if name == "delete":
            for key in way:
                trail.append((at, key))
                at = at.get(key) if isinstance(at, dict) else None
            if isinstance(at, dict) and last in at:
                del at[last]
                for above, key in reversed(trail):
                    if above[key]:
                        break
                    del above[key]
            continue
        if name == "remove":
            for key in way:
                at = at.get(key) if isinstance(at, dict) else None
            if isinstance(at, dict) and isinstance(at.get(last), list):
                at[last] = [x for x in at[last] if x != value[0]]
            continue
        probe, good = data, True
        for key in way:
            if not isinstance(probe, dict):
                good = False
                break
            probe = probe.get(key, {})
        if not good or not isinstance(probe, dict) or name == "append" and last in probe and not isinstance(probe[last], list):
            continue
        for key in way:
            at = at.setdefault(key, {})
        if name == "set":
            at[last] = value[0]
        else:
            at.setdefault(last, []).append(value[0])
    return data


def made(rng):
    values = [1, "x", None, True, [1, 2], [], {"q": 1}, {}, 2.5]
    keys = ["a", "b", "c"]
    path = lambda: ".".join(rng.choice(keys) for _ in range(rng.randint(1, 3)))
    ops = []
    for _ in range(4):
        name = rng.choice(edits.OPS)
        ops.append((name, path()) if name == "delete" else (name, path(), rng.choice(values)))
    return ops


def tree(rng, depth=0):
    return {k: tree(rng, depth + 1) if depth < 2 and rng.random() < 0.5 else rng.choice([1, "s", [1, "x"], None, {}]) for k in "abc" if rng.random() < 0.7}


def test_edits_equal_dictionaries(spark):
    rng = random.Random(9)
    data = [tree(rng) for _ in range(40)] + [{}]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(data)], "i int, m string").withColumn("m", F.parse_json("m")).cache()
    for ops in [made(rng) for _ in range(8)]:
        got = {r["i"]: json.loads(r["m"]) for r in rows.select("i", F.to_json(edits.edited(F.col("m"), *ops)).alias("m")).collect()}
        for i, d in enumerate(data):
            assert got[i] == plain(d, ops), (d, ops)


def test_values_from_columns_null_metadata_and_bad_edits(spark):
    row = spark.range(1).select(F.lit(None).cast("variant").alias("m"), F.lit(7).alias("n"), F.struct(F.lit("x").alias("y")).alias("s"))
    out = row.select(F.to_json(edits.edited(F.col("m"), ("set", "a.b", F.col("n")), ("set", "c", F.col("s")), ("append", "l", F.col("n")))).alias("j")).first()["j"]
    assert json.loads(out) == {"a": {"b": 7}, "c": {"y": "x"}, "l": [7]}
    for bad in [("move", "a", 1), ("set", "a"), ("delete", "a", 1)]:
        with pytest.raises(ValueError):
            edits.edited(F.col("m"), bad)


def test_many_deep_edits_stay_small(spark):
    ops = [("set", "a.b.c.d.e.f", i) for i in range(6)] + [("set", "n", F.col("k")), ("set", "o", F.expr("try_variant_get(m, '$.n', 'int')"))]
    row = spark.range(1).select(F.lit(1).alias("k"), F.parse_json(F.lit('{"n": 7}')).alias("m"), F.lit(2).alias("l"))
    out = edits.applied(row, "m", *ops)
    assert out.columns == ["k", "m", "l"]  # values are those before any edit
    assert json.loads(out.select(F.to_json("m").alias("j")).first()["j"]) == {"a": {"b": {"c": {"d": {"e": {"f": 5}}}}}, "n": 1, "o": 7}


def test_edits_make_one_revision_where_they_change_something(spark):
    rows = spark.createDataFrame([("a", json.dumps({"k": 1})), ("b", json.dumps({"k": 2}))], "id string, m string").select("id", F.parse_json("m").alias("metadata"))
    log = mutation.added(rows, 1)
    ids = rows.select("id")
    log = mutation.edit(log, ids, 5, ("set", "k", 2), ("set", "k", 2))
    got = sorted((r["id"], r["revision"], r["archived_at"]) for r in log.select("id", "revision", "archived_at").collect())
    assert got == [("a", 1, 5), ("a", 2, None), ("b", 1, None)]


def test_metrics_of_open_metadata(spark):
    meta = {"LastUpdateMetric": {"RxBytes": 5, "Start": 10, "Last": 20}}
    rows = spark.createDataFrame([("a", json.dumps(meta)), ("b", "{}")], "id string, m string").select("id", F.parse_json("m").alias("metadata"))
    graph = Graph(mutation.added(rows, 1), mutation.added(rows, 1))
    found = graph.V().Metrics()
    assert [(r["key"], r["start"], r["last"], r["RxBytes"], r["TxBytes"]) for r in found.df.collect()] == [("a", 10, 20, 5, 0)]
    assert found.Sum("RxBytes").first()["sum"] == 5
