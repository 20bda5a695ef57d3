"""Every registered query of the core against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sluice.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    other = duck.sql(ORACLES[name])
    assert sorted(other.columns) == cols
    at = [other.columns.index(c) for c in cols]
    ours = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in other.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
