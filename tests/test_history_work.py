"""A put sorts what it takes once: one shuffle by id, whatever is open or closed in it."""

from pyspark.sql import functions as F

from loomgraph.sources.history import History


def test_a_change_is_resolved_in_one_shuffle(spark, tmp_path):
    names = ["id", "created_at", "updated_at", "archived_at", "revision"]
    frame = lambda rows: spark.createDataFrame(rows, "id string, created_at long, updated_at long, archived_at long, revision long")
    live = frame([("a", 1, 1, None, 1), ("b", 1, 1, None, 1), ("c", 1, 1, None, 1), ("d", 1, 1, None, 1)])
    rows = frame([
        ("a", 1, 5, None, 2), ("b", 1, 1, 4, 1), ("b", 1, 1, 4, 1), ("b", 1, 4, None, 2), ("c", 1, 3, None, 1), ("e", 2, 2, None, 1), ("e", 2, 2, 7, 1), ("f", None, 1, None, 1), ("f", None, 1, 6, 1)])
    out = History(spark, f"file://{tmp_path}/t")._resolved(rows.repartition(3), live.repartition(3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan
    assert sorted(map(tuple, out.select(*names).collect()), key=str) == sorted([
        ("a", 1, 1, 5, 1), ("a", 1, 5, None, 2), ("b", 1, 1, 4, 1), ("b", 1, 4, None, 2), ("c", 1, 3, None, 1), ("d", 1, 1, None, 1),
        ("e", 2, 2, 7, 1), ("f", None, 1, None, 1), ("f", None, 1, 6, 1)], key=str)


def test_stored_orders_are_dealt_by_their_size(spark, monkeypatch):
    from loomgraph.plans import store_queries
    from loomgraph.sources import star

    told = []
    monkeypatch.setattr(star, "dealt", lambda *a: told.append(a[2:]))
    rows = store_queries.store_log
    assert rows(spark, "/root/testdata/sf0.001").filter(F.col("revision") > 2).count() == 0 and told == [("orders",)]
