"""Queries that read their whole table, and that none of the queries is checked on an empty result."""

import duckdb
import pytest

from loomgraph.plans import queries
from loomgraph.sources import star
from tests.test_queries import TABLES


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    return con


def test_results_are_not_empty(con):
    empty = [name for name, sql in queries.ORACLES.items() if not con.execute(f"SELECT count(*) FROM ({sql})").fetchall()[0][0]]
    assert empty == []
    assert con.execute(f"SELECT count(*) FROM ({queries.ORACLES['metrics_aggregates']})").fetchall()[0][0] > 100


@pytest.mark.parametrize("name", ["v_ipv4range", "v_flows"])
def test_queries_without_rows_on_the_smallest_table(spark, con, name):
    ours = queries.QUERIES[name](spark, LARGER)
    found = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, found)) == sorted(str(tuple(r)) for r in ours.collect()) and found


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_aggregates_of_the_whole_table(spark, sf):
    counters, length = ["ab_packets", "ab_bytes", "ba_packets", "ba_bytes"], 3_600_000
    points = [(r["start"], r["last"], [r[c] for c in counters]) for r in star.flow_metrics(spark, f"/root/testdata/{sf}").collect()]
    first, last = min(p[0] for p in points), max(p[1] for p in points)
    expected, beyond = {}, 0
    for start, end, values in points:
        if start >= last:  # in no bucket: buckets end before their last instant
            beyond += 1
            continue
        left, at, i = values, start, (start - first) // length
        while True:
            cut = first + (i + 1) * length
            part = left if end <= cut or start == end else [int(v * (cut - at) / (end - at)) for v in left]
            whole = not any(part) and at == start
            part = values if whole else part
            expected[first + i * length] = [x + y for x, y in zip(expected.get(first + i * length, [0] * 4), part)]
            if whole or end <= cut:
                break
            left, at, i = [x - y for x, y in zip(left, part)], cut, i + 1
    got = {r["start"]: [r[c] for c in counters] for r in queries.QUERIES["metrics_aggregates_whole"](spark, f"/root/testdata/{sf}").collect()}
    assert got == expected and len(got) > 700 and beyond == 1
    assert sum(v[2] for v in got.values()) == len(points) - 1


def test_sockets_of_all_hosts(spark, con):
    rows = queries.QUERIES["sockets_of_hosts"](spark, LARGER).collect()
    hosts = con.execute("SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_linenumber = 1").fetchall()[0][0]
    assert len({r["node"] for r in rows}) == hosts > 1 and len(rows) > queries.QUERIES["sockets"](spark, LARGER).count()
