"""The queries against their SQL, and the pipeline's stages."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import clashing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    other = c.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(other.columns) == cols
    at = [other.columns.index(x) for x in cols]
    assert sorted(repr([r[x] for x in cols]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in other.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_cover_all_rows(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert QUERIES[name](spark, SF).select("doc_id").distinct().count() == n


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "src0", None), (10**6 + 1, "", "en", None, 0)], docs.schema)
    now = clashing(docs.unionByName(odd))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.filter(F.col("doc_id") >= 10**6).count() == 2, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "decontaminate", "packing"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert pieces.select("doc_id").distinct().count() == now.count()
    # Each decision took effect on what the next stage saw.
    from sluice.llm import decontaminate, minhash

    assert minhash.near_duplicates(now).filter("NOT kept").count() == 0
    assert decontaminate.contamination(now, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count() == 0


def test_empty_input(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF) if "text" in now.columns else now
        assert now.count() == 0


def test_core_does_not_import_this_subpackage():
    import re
    from pathlib import Path

    root = Path(__file__).parents[2]
    for p in (root / "sluice").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"sluice\.llm|corpus_pipeline", p.read_text()), p
