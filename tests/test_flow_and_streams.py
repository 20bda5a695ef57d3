import logging
import os
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from sluice.flow import flow
from sluice.operators import inspect as I
from sluice.operators.ordering import NoOrder
from sluice.streaming import streams
from sluice import support as S


def test_flow(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 3) for k in range(12)], "k int, m int")
    f = flow(df, "k")
    assert [r["k"] for r in f.skip(2).take_while(F.col("m") != 1).to_list()] == [2, 3]
    assert f.until(3).count() == 4 and f.until(F.col("m") == 2).count() == 3
    labels = f.cases(F.col("m") == 0, F.col("m") == 1).select_case(F.lit("zero"), F.lit("one")).all_cases()
    assert labels.count() == 8
    assert f.build_string(F.col("k")).startswith("{0, 1,") and f.aggregate(F.col("k").cast("long"), F.lit(0).cast("long"), lambda a, x: a * 2 + x) > 0
    assert f.group_by(["m"], F.count(F.lit(1)).alias("n")).first()["n"] == 4
    assert f.join(df.toDF("k2", "m2"), "k", "k2").count() == 12 and f.distinct(F.col("m")).count() == 3
    assert f.merge_ordered(df).take(2).to_list()[1]["k"] == 0
    with pytest.raises(NoOrder):
        flow(df).take(1)
    f.write_parquet(str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 12


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in range(10)], "k int")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    assert streams.run_available(stream.filter("k > 4"), "above_four").count() == 5
    assert [r["k"] for r in streams.bounded(df, 3, ["k"], "drop_newest").collect()] == [0, 1, 2]
    assert sorted(r["k"] for r in streams.bounded(df, 3, ["k"], "drop_oldest").collect()) == [7, 8, 9]
    seen = []
    q = streams.stop_when(stream, lambda rows: not rows.isEmpty(), lambda rows: seen.append(rows.count()), "100 milliseconds")
    q.awaitTermination(60)
    assert seen and not q.isActive


def test_inspection(spark, caplog):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    out = []
    assert I.spy(df, "tag", out=out.append) is df and out == ["--- tag ---", "k=1, s=a"]
    I.display(df, out=out.append)
    assert out[-1] == "0: k=1, s=a" and "Physical Plan" in I.explain(df)
    with caplog.at_level(logging.INFO, "sluice"):
        I.log_spy(df, "mine")
    assert "k=1" in caplog.text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS v", "id * 3 AS w").write.parquet(str(tmp_path / "t"))
    plan = I.explain(flow(spark.read.parquet(str(tmp_path / "t")), "id").where(F.col("v") > 50).select("id").df)
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,50)]" in plan and "ReadSchema: struct<id:bigint,v:bigint>" in plan


def test_support(tmp_path):
    seen = []
    w = S.Watched(1) + seen.append
    w.value = 2
    w.value = 2
    assert seen == [2]
    assert S.check_arguments([S.Requirement("path", "p", mandatory=True)], ["-p", "x"]) == {"path": "x"}

    @dataclass
    class Config:
        n: int
        name: str = "a"

    assert S.configure(Config, ["--n", "3"]) == Config(3, "a")
    p = S.FilePath(tmp_path / "f")
    assert p.status is S.PathStatus.MISSING_FILE
    p.path.write_text("x")
    assert p.rename(".old").name == "f.old" and os.path.exists(tmp_path / "f.old")
    with pytest.raises(ValueError):
        S.Guard.in_range(5, 0, 4, "n")
    rule = S.Sequence_(S.Terminal("a"), S.OneOf(S.Terminal("b"), S.Sequence_(S.Terminal("c"), S.Terminal("d"))))
    m = S.TokenMatcher(rule)
    assert m.accept("a") == S.Digestion.DIGESTED and m.accept("z") == S.Digestion.NONE and m.accept("c") == S.Digestion.DIGESTED
    assert m.accept("d") & S.Digestion.COMPLETED
    sent = []
    h = S.KafkaHandler(lambda t, b: sent.append((t, b)), "logs")
    h.emit(logging.LogRecord("n", logging.INFO, "", 0, "hello", (), None))
    assert sent == [("logs", b"hello")]
