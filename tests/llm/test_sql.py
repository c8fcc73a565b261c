"""The text queries that SQL can tell against their SQL."""

import duckdb
import pytest

from loomgraph.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, con, name):
    ours = queries.QUERIES[name](spark, DIR)
    columns = sorted(ours.columns)
    theirs = con.execute(queries.ORACLES[name])
    found = [d[0] for d in theirs.description]
    assert sorted(found) == columns
    expected = sorted(str(tuple(row[found.index(c)] for c in columns)) for row in theirs.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in ours.collect()) == expected and expected
