"""Every query of the graph steps against its SQL."""

import duckdb
import pytest

from loomgraph.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ours = QUERIES[name](spark, DIR)
    columns = sorted(ours.columns)
    theirs = con.execute(ORACLES[name])
    assert sorted(d[0] for d in theirs.description) == columns
    at = [[d[0] for d in theirs.description].index(c) for c in columns]
    expected = sorted(str(tuple(row[i] for i in at)) for row in theirs.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in ours.collect()) == expected


def test_entry_works_without_the_optional_part():
    import os
    import shutil
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as to:
        shutil.copytree(os.path.join(root, "loomgraph"), os.path.join(to, "loomgraph"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(root, "__spark_entry__.py"), to)
        done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=to, env={**os.environ, "PYTHONPATH": to}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[0] == str(len(QUERIES))
