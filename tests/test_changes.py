"""Changes within one millisecond, stored change sets, and watchers over restarts."""

import json
import random

from loomgraph.sources.store import Store
from loomgraph.streaming import changes


def change(op, id, at, revision, meta=None, kind="node", parent=None, child=None):
    return (op, kind, id, parent, child, at, revision, json.dumps(meta or {"Type": "host"}))


def log(spark, rows):
    return spark.createDataFrame(rows, changes.SCHEMA)


def pick(df):
    return sorted(map(tuple, df.select("id", "created_at", "updated_at", "deleted_at", "archived_at", "revision").collect()), key=str)


def test_deleted_and_added_again_in_one_millisecond(spark):
    rows = [change("add", "a", 1, 1), change("add", "a", 5, 1), change("delete", "a", 5, 2),  # there before: it goes, and comes again
            change("delete", "b", 5, 2), change("add", "b", 5, 1),  # not there before: it comes, and goes
            change("add", "c", 1, 1), change("update", "c", 5, 2), change("delete", "c", 5, 3), change("add", "c", 5, 1)]
    got = pick(changes.revisions(log(spark, rows)))
    assert got == sorted([("a", 1, 1, 5, 5, 1), ("a", 5, 5, None, None, 1), ("b", 5, 5, 5, 5, 1), ("c", 1, 1, None, 5, 1), ("c", 1, 5, 5, 5, 2), ("c", 5, 5, None, None, 1)], key=str)
    for cut in range(1, len(rows)):
        rows_ = sorted(rows, key=lambda r: (r[5], r[2]))
        cut_at = next((i for i in range(cut, len(rows_)) if rows_[i][5] != rows_[i - 1][5]), len(rows_))  # a millisecond comes whole
        live = changes.advance(changes.advance(None, log(spark, rows_[:cut_at])), log(spark, rows_[cut_at:]))
        assert sorted(r["id"] for r in live.collect()) == ["a", "c"]
        if cut_at == len(rows_):
            break


def test_a_sequence_number_orders_changes(spark):
    rows = [(*change("add", "a", 5, 1), 3), (*change("delete", "a", 5, 2), 2), (*change("add", "a", 5, 1), 1)]
    got = changes.revisions(spark.createDataFrame(rows, changes.SCHEMA + ", seq long"))
    assert got.filter("archived_at is null").count() == 1 and got.count() == 2


def test_change_sets_in_a_store_equal_the_whole_log(spark, tmp_path):
    rng = random.Random(4)
    store, rows, alive = Store(spark, str(tmp_path / "s")), [], {}
    for at in range(1, 41):
        id = f"n{rng.randrange(5)}"
        if id not in alive:
            alive[id] = 1
            rows.append(change("add", id, at, 1, {"Type": "host", "N": at}))
        elif rng.random() < 0.3:
            rows.append(change("delete", id, at, alive.pop(id) + 1))
        else:
            alive[id] += 1
            rows.append(change("update", id, at, alive[id], {"Type": "host", "N": at}))
    rows.append(change("add", "e", 41, 1, {"RelationType": "own"}, "edge", "n0", "n1"))
    for i in range(0, 41, 14):
        for _ in range(2):  # a set that comes again, as after a restart, changes nothing
            changes.put(store, log(spark, rows[i : i + 14]), f"set-{i}")
        whole = changes.revisions(log(spark, rows[: i + 14]))
        assert pick(store.read("nodes")) == pick(whole.filter("kind = 'node'"))
    assert [(r["parent"], r["child"]) for r in store.graph().E().df.collect()] == [("n0", "n1")]


def test_watchers_tell_nothing_twice_over_a_restart(spark, tmp_path):
    seen, fired = [], []

    def watchers():  # of a new process: nothing is left in them
        sub = changes.Subscription(lambda g: g.V().Has("Type", "host").SubGraph(), lambda d: seen.append(sorted((r["change"], r["id"]) for r in d.collect())))
        return sub, changes.Alert("down", lambda g: g.V().Has("State", "DOWN").df.select("id"), lambda name, d: fired.append(d.count()))

    for i, rows in enumerate([[change("add", "a", 1, 1, {"Type": "host", "State": "DOWN"})], [change("add", "b", 2, 1)], [change("delete", "a", 3, 2)]]):
        log(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"x={i}"))
        source = spark.readStream.schema(changes.SCHEMA + ", x int").parquet(str(tmp_path / "in")).drop("x")
        changes.follow(source, str(tmp_path / "log"), str(tmp_path / "c"), *watchers()).awaitTermination()
    assert seen == [[("added", "a")], [("added", "b")], [("removed", "a")]] and fired == [1]
    sub, alert = watchers()
    sub.state, alert.state = (f"{tmp_path}/log-watchers/{n}" for n in ("subscription-0", "down-1"))
    graph = Store(spark, str(tmp_path / "log-live")).graph()
    sub.check(graph, 2)  # the last micro-batch runs again
    alert.check(graph, 2)
    assert len(seen) == 3 and fired == [1]
