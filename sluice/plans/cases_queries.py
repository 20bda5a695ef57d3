"""Queries of the cases family."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import cases as C
from sluice.plans.registry import query, table

PRICE = "o_totalprice"
MONEY = "decimal(14,2)"
BAND = "CASE WHEN o_totalprice > 250000 THEN 0 WHEN o_totalprice > 100000 THEN 1 ELSE 2 END"

CLASS = "CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 3 END"


def bands():
    return F.col(PRICE) > 250000, F.col(PRICE) > 100000


@query("cases_select_case", f"""
SELECT label, count(*) AS n, sum(cast(o_totalprice AS DECIMAL(14,2)))::DOUBLE AS total
FROM (SELECT CASE {BAND} WHEN 0 THEN 'high' WHEN 1 THEN 'middle' ELSE 'low' END AS label, o_totalprice FROM orders) GROUP BY label""")
def cases_select_case(spark, sf_dir):
    routed = C.cases(table(spark, sf_dir, "orders").select("o_totalprice"), *bands())
    labelled = C.select_case(routed, F.lit("high"), F.lit("middle"), F.lit("low")).filter("new_item IS NOT NULL")
    return labelled.groupBy(F.col("new_item").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(PRICE).cast(MONEY)).cast("double").alias("total"))


@query("cases_category", f"SELECT o_orderkey, {BAND} AS category FROM orders")
def cases_category(spark, sf_dir):
    return C.cases(table(spark, sf_dir, "orders"), *bands()).select("o_orderkey", "category")


@query("cases_by_key", f"SELECT event_id, {CLASS} AS category FROM events")
def cases_by_key(spark, sf_dir):
    return C.cases_by_key(table(spark, sf_dir, "events"), "event_type", "click", "purchase", "error").select("event_id", "category")


@query("cases_two_stage", f"""SELECT o_orderkey, CASE {BAND} WHEN 0 THEN 'H' || cast(o_orderkey * 2 AS VARCHAR) WHEN 1 THEN 'M' || cast(o_orderkey + 1 AS VARCHAR) END AS new_item FROM orders""")
def cases_two_stage(spark, sf_dir):
    first = C.select_case(C.cases(table(spark, sf_dir, "orders"), *bands()), F.col("o_orderkey") * 2, F.col("o_orderkey") + 1)
    second = C.select_case(first, lambda x: F.concat(F.lit("H"), x.cast("string")), lambda x: F.concat(F.lit("M"), x.cast("string")))
    return second.select("o_orderkey", "new_item")


@query("select_case_indexed", f"""SELECT o_orderkey, CASE {BAND} WHEN 0 THEN p WHEN 1 THEN -p END AS new_item FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)""")
def select_case_indexed(spark, sf_dir):
    routed = C.cases(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), *bands())
    return C.select_case_indexed(routed, ["o_orderkey"], lambda p: p, lambda p: -p).select("o_orderkey", "new_item")


@query("select_cases_multi", f"""SELECT o_orderkey, {BAND} AS category, CASE WHEN {BAND} = 0 THEN o_orderkey END AS result_1, CASE WHEN {BAND} = 1 THEN o_orderstatus END AS result_2 FROM orders""")
def select_cases_multi(spark, sf_dir):
    routed = C.cases(table(spark, sf_dir, "orders"), *bands())
    return C.select_cases(routed, F.col("o_orderkey"), F.col("o_orderstatus")).select("o_orderkey", "category", "result_1", "result_2")


@query("select_cases_seven", """SELECT event_id, CASE WHEN k = 0 THEN event_id END AS result_1, CASE WHEN k = 1 THEN event_type END AS result_2, CASE WHEN k = 2 THEN value END AS result_3,
CASE WHEN k = 3 THEN user_id END AS result_4, CASE WHEN k = 4 THEN props END AS result_5, CASE WHEN k = 5 THEN value > 10 END AS result_6, CASE WHEN k = 6 THEN event_id * 7 END AS result_7
FROM (SELECT *, event_id % 8 AS k FROM events)""")
def select_cases_seven(spark, sf_dir):
    k = F.col("event_id") % 8
    routed = C.cases(table(spark, sf_dir, "events"), *[k == i for i in range(7)])
    c = F.col
    out = C.select_cases(routed, c("event_id"), c("event_type"), c("value"), c("user_id"), c("props"), c("value") > 10, c("event_id") * 7)
    return out.select("event_id", *C.results(out))


@query("all_cases", f"SELECT CASE {BAND} WHEN 0 THEN 0 WHEN 1 THEN o_orderkey END AS new_item FROM orders WHERE {BAND} < 2")
def all_cases(spark, sf_dir):
    routed = C.cases(table(spark, sf_dir, "orders"), *bands())
    return C.all_cases(C.select_case(routed, F.lit(0).cast("long"), F.col("o_orderkey")))


@query("all_cases_unfiltered", f"SELECT CASE {BAND} WHEN 0 THEN o_orderkey END AS new_item FROM orders")
def all_cases_unfiltered(spark, sf_dir):
    return C.all_cases(C.select_case(C.cases(table(spark, sf_dir, "orders"), *bands()), F.col("o_orderkey")), drop_null=False)


@query("all_cases_multi", f"SELECT CASE {BAND} WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS result FROM orders WHERE {BAND} < 2")
def all_cases_multi(spark, sf_dir):
    routed = C.cases(table(spark, sf_dir, "orders"), *bands())
    return C.all_cases_multi(C.select_cases(routed, F.col("o_orderstatus"), F.col("o_orderpriority")))


@query("uncase", "SELECT * FROM nation")
def uncase(spark, sf_dir):
    return C.uncase(C.select_case(C.cases(table(spark, sf_dir, "nation"), F.col("n_nationkey") > 5), F.lit("x")))


@query("cases_count", f"SELECT {BAND} AS category, count(*) AS n FROM orders GROUP BY 1")
def cases_count(spark, sf_dir):
    return C.count_cases(C.cases(table(spark, sf_dir, "orders"), *bands()))


@query("cases_route", f"SELECT o_orderkey, {BAND} AS sink FROM orders WHERE {BAND} < 2")
def cases_route(spark, sf_dir):
    """Each category to its own folder of the shared store, and all of them read back."""
    from sluice.operators.storage import scratch

    folder = scratch(spark, "routes")
    routed = C.cases(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), *bands())
    C.for_each_case(routed, *[lambda rows, k=k: C.uncase(rows).select("o_orderkey").write.parquet(f"{folder}/{k}") for k in range(2)])
    parts = [spark.read.parquet(f"{folder}/{k}").withColumn("sink", F.lit(k)) for k in range(2)]
    return parts[0].unionByName(parts[1])


@query("cases_with_note", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'above 200000' ELSE 'below 200000' END AS new_item FROM orders")
def cases_with_note(spark, sf_dir):
    noted = C.with_note(table(spark, sf_dir, "orders"), {"limit": 200000})
    routed = noted.cases(lambda n: F.col(PRICE) > n["limit"]).select_case(lambda n: F.lit(f"above {n['limit']}"), lambda n: F.lit(f"below {n['limit']}"))
    return routed.without_note().select("o_orderkey", "new_item")
