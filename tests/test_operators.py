import pytest
from pyspark.sql import functions as F

from sluice.operators import aggregate as A
from sluice.operators import cases as C
from sluice.operators import merge as M
from sluice.operators import ordering as O
from sluice.operators import project as P
from sluice.operators import sets as S
from sluice.operators import slicing as L
from sluice.operators.parallel import as_parallel


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([(k, k * k % 7) for k in range(10)], "k int, v int").repartition(3)


def ks(df):
    return sorted(r["k"] for r in df.collect())


def test_positions_are_dense_for_any_bucket_count(spark, ten):
    for n in (1, 3, 50):
        got = {r["k"]: r["_pos"] for r in O.positions(ten, ["k"], buckets=n).collect()}
        assert got == {k: k for k in range(10)}
    text = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "t string")
    assert [r["t"] for r in O.positions(text, ["t"], buckets=2).orderBy("_pos").collect()] == [None, "a", "b", "c"]
    assert O.positions(ten.limit(0), ["k"]).count() == 0


def test_cuts(ten):
    assert ks(L.take_while(ten, ["k"], F.col("v") < 4)) == [0, 1]
    assert ks(L.skip_while(ten, ["k"], F.col("v") < 4)) == list(range(2, 10))
    assert ks(L.until(ten, ["k"], F.col("v") == 4)) == [0, 1, 2]
    assert ks(L.until(ten, ["k"], F.col("v") == 99)) == list(range(10))
    assert ks(L.skip_while(ten, ["k"], F.col("v") < 99)) == []
    assert ks(L.take(ten, ["k"], -1)) == [] and ks(L.until_index(ten, ["k"], -1)) == []
    assert ks(L.take_range(ten, ["k"], range(2, 4))) == [2, 3] and ks(L.skip(ten, ["k"], 8)) == [8, 9]
    seen = []
    assert [r["k"] for r in L.until_signal(ten, ["k"], lambda: seen.append(1) or len(seen) == 3)] == [0, 1, 2]
    with pytest.raises(O.NoOrder):
        L.take(ten, [], 1)
    with pytest.raises(ValueError):
        L.take_slice(ten, ["k"], -1, 2)


def test_terminals(ten):
    assert L.first(ten, ["k"], F.col("k") > 3)["k"] == 4
    with pytest.raises(LookupError):
        L.first(ten, ["k"], F.col("k") > 30)
    assert L.first_or_default(ten, ["k"], F.col("k") > 30) is None
    with pytest.raises(ValueError):
        L.single(ten)
    assert L.single(ten.filter("k = 5"))["k"] == 5 and L.single_or_default(ten.filter("k > 50")) is None
    cursor = L.Cursor(ten.filter("k = 1"))
    assert cursor.try_next()[0] and cursor.try_next() == (False, None) and cursor.next_or_default() is None
    assert A.any_(ten, F.col("k") == 1) and not A.all_(ten, F.col("k") == 1) and A.is_null_or_empty(None)
    with pytest.raises(ValueError):
        A.to_dictionary(ten, "v", "k")


def test_cases_edges(spark, ten):
    routed = C.cases(ten, F.col("v") > 3, F.lit(None).cast("boolean"), F.col("k") < 2)
    assert {r["k"]: r["category"] for r in routed.collect()}[0] == 2
    with pytest.raises(ValueError):
        C.cases_by_key(ten, "k", 1, 1)
    chosen = C.select_case(routed, F.lit("a"))
    assert C.all_cases(chosen).count() < C.all_cases(chosen, drop_null=False).count() == 10
    assert set(C.uncase(chosen).columns) == {"k", "v"}
    seen = []
    C.for_each_case(routed, lambda d: seen.append(d.count()), None, lambda d: seen.append(d.count()))
    assert sum(seen) == routed.filter("category in (0, 2)").count()
    multi = C.select_cases(routed, F.col("k"), F.col("k").cast("string"))
    assert C.all_cases_multi(multi).first()["result"].startswith("{")
    closed = []
    df, note = C.with_note(ten, 3)
    assert note == 3 and C.with_note(df, 3).without_note(closed.append).count() == 10 and closed == [3]


def test_cases_tables(spark, ten):
    routed = C.cases(ten, F.col("k") < 5)
    C.write_tables(routed, "low_table", "high_table", mode="overwrite")
    assert spark.table("low_table").count() == 5 and set(spark.table("high_table").columns) == {"k", "v"}
    C.merge_tables(C.cases(spark.createDataFrame([(1, 100), (77, 7)], "k int, v int"), F.lit(True)), ("low_table", "k"))
    assert {r["k"]: r["v"] for r in spark.table("low_table").collect()}[1] == 100 and spark.table("low_table").count() == 6


def test_upsert_keeps_nulls_and_partial_columns(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    u = spark.createDataFrame([(2, None), (3, "c")], "k int, s string")
    assert sorted(map(tuple, M.upserted(t, u, "k").collect())) == [(1, "a", 1), (2, None, 2), (3, "c", None)]


def test_sets(spark, ten):
    got = S.distinct_first(ten, ["k"], F.col("v"))
    assert {r["v"]: r["k"] for r in got.collect()} == {0: 0, 1: 1, 4: 2, 2: 3}
    u = S.Unified().unify(ten, "a").unify(ten, "b", F.col("k") == 1)
    assert u.unlisten("zz") is False and u.read().count() == 11
    with pytest.raises(RuntimeError):
        u.unify(ten, "late")
    with pytest.raises(S.SourceFailed, match="bad"):
        S.Unified().unify(ten, "bad", F.col("nothing") == 1).read()
    kept = S.Unified(S.ErrorMode.CONTINUE).unify(ten, "good").unify(ten, "bad", F.col("nothing") == 1)
    assert kept.read().count() == 10


def test_folds(spark, ten):
    assert A.fold_first(ten.limit(0), F.col("k"), ["k"], lambda a, x: a + x).first()["result"] is None
    assert A.build_string(ten.filter("k < 3"), F.col("k"), ["k"]).first()["text"] == "{0, 1, 2}"
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.createDataFrame([(2**31 - 1,), (1,)], "x int").agg(A.sum_int(F.col("x"))).collect()
    assert ten.limit(0).agg(A.sum_long(F.col("k")).alias("s")).first()["s"] == 0
    df, seen = A.observed(ten, n=F.count(F.lit(1)))
    A.do(df)
    assert seen.get["n"] == 10
    with pytest.raises(ValueError):
        P.buffer(ten, ["k"], 0)


def test_parallel(ten):
    p = as_parallel(ten).with_max_concurrency(1000).with_buffer_size(1)
    assert p.settings.concurrency == 100 and p.settings.buffer == 10
    with pytest.raises(ValueError):
        p.with_max_concurrency(0)
    assert p.with_merge_options("auto_buffered").settings.merge == "auto_buffered" and p.with_timeout(9).settings.timeout == 9
    total = A.long_accumulator(ten.sparkSession)
    A.do(ten, lambda r: total.add(r["k"]))
    assert total.value == 45
    bad = as_parallel(ten).continue_on_error().map_rows(lambda r: {"k": 1 // r["k"]}, "k int")
    assert len(bad.collect()) == 9


def test_positions_plan_has_no_single_partition_step(ten):
    plan = O.positions(ten, ["k"], buckets=3)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_composite_join_of_all_orders(spark, tmp_path):
    from sluice.plans.catalogue import QUERIES

    rows = [(1, 1, "O"), (499, 1, "F"), (500, 1, "O"), (501, 1, "O"), (502, 2, "O"), (503, 1, None), (504, 1, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r["a_key"], r["b_key"]) for r in QUERIES["join_composite"](spark, str(tmp_path)).collect()}
    assert got == {(1, 500), (1, 501), (500, 501)}


def test_outer_joins_of_whole_tables(spark, tmp_path):
    from sluice.plans.catalogue import QUERIES

    put = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("customer", [(1,), (100,), (2,)], "c_custkey long")
    put("orders", [(1, 1, "O"), (201, 100, "F"), (203, 100, None), (250, 7, "P")], "o_orderkey long, o_custkey long, o_orderstatus string")
    put("supplier", [(1,), (3,), (100,)], "s_suppkey long")
    got = lambda name: sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    pairs = [(1, 1), (100, 201), (100, 203), (2, None)]
    assert got("join_left") == sorted([(1, 1, "O"), (100, 201, "F"), (100, 203, "-"), (2, None, "-")], key=repr)
    assert got("join_right") == sorted(pairs, key=repr)
    assert got("join_full") == sorted([(1, 1), (100, 100), (2, None), (None, 3)], key=repr)
    assert got("null_handling") == sorted([(1, False, "O", "xO", False), (100, False, "F", "xF", False), (100, False, "none", "x", True), (2, True, "none", "x", True)], key=repr)


def test_ranges_of_a_hot_or_constant_first_key_are_even(spark):
    rows = spark.range(20000).select((F.col("id") % 3).alias("hot"), F.lit(1).alias("same"), "id")
    for keys in (["hot", "id"], ["same", "id"]):
        sizes = [r["count"] for r in O.ranged(rows, keys, 8).groupBy("_part").count().collect()]
        assert len(sizes) >= 6 and max(sizes) < 20000 / 3
        got = O.positions(rows, keys, buckets=8).orderBy("_pos").select("_pos", *keys).collect()
        assert [r["_pos"] for r in got] == list(range(20000)) and [tuple(r)[1:] for r in got] == sorted(tuple(r)[1:] for r in got)


def test_no_step_of_an_ordered_operator_sees_all_rows(spark):
    from sluice.operators import project, slicing

    rows = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, "the").otherwise("x").alias("w"))
    for df in (slicing.skip(rows, ["id"], 10), project.to_lines(rows, "w", "the", ["id"]), O.running(rows, ["id"], F.lit(1), "n")):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in slicing.skip(rows, ["id"], 990).collect()) == list(range(990, 1000))
    assert {r["line_no"]: r["line"] for r in project.to_lines(rows, "w", "the", ["id"]).collect()} == {k: "x" * 6 if k else "" for k in range(143)}
    assert O.positions(rows.limit(0), ["id"]).count() == 0
