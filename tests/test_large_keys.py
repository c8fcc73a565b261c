"""Packets made from keys beyond the bits of an address or id: flows and datagrams of different keys stay apart."""

import duckdb
import pytest

from loomgraph.plans.queries import ORACLES, QUERIES

#: What copy r of a table adds to its keys: all of them equal in their low 16 bits.
SHIFTS = {
    "orders": "o_orderkey + r * 16777216 AS o_orderkey, o_custkey + r * 65536 AS o_custkey",
    "lineitem": "l_orderkey + r * 16777216 AS l_orderkey, l_partkey + r % 2 * 65536 AS l_partkey, l_suppkey + r // 2 * 65536 AS l_suppkey",
}


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    top = tmp_path_factory.mktemp("copied")
    con = duckdb.connect()
    for name, shifts in SHIFTS.items():
        con.execute(f"COPY (SELECT * EXCLUDE (r) REPLACE ({shifts}) FROM '/root/testdata/sf0.001/{name}.parquet', range(3) t(r)) TO '{top}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{top}/{name}.parquet'")
    return con, str(top)


@pytest.mark.parametrize("name", ["ip_datagrams", "ip_reassembled", "tunnel_flows"])
def test_keys_with_equal_low_bits(spark, copied, name):
    con, top = copied
    ours, theirs = QUERIES[name](spark, top), con.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(str(tuple(r[c] for c in columns)) for r in ours.collect()) == sorted(str(r) for r in theirs.fetchall())
