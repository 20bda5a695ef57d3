"""Queries of the relational half: joins, groups, windows, sets, scalars, arrays and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import scalars as N
from sluice.functions import text as X
from sluice.operators import merge as M
from sluice.operators import relational as R
from sluice.operators import sets as S
from sluice.plans.registry import query, table

MONEY = "decimal(14,2)"


def t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


@query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("order_take_skip", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 15 OFFSET 10")
def order_take_skip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rows.orderBy(F.col("o_orderpriority").desc(), "o_totalprice", "o_orderkey").offset(10).limit(15)


@query("group_agg", """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(cast(l_extendedprice AS DECIMAL(14,2)))::DOUBLE AS total, min(l_quantity) AS least, max(l_quantity) AS most,
round(avg(l_quantity), 6) AS mean, count(*) FILTER (l_discount > 0.05) AS n_cheap FROM lineitem GROUP BY ALL""")
def group_agg(spark, sf_dir):
    return R.group(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("total"),
        F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.count_if(F.col("l_discount") > 0.05).alias("n_cheap"),
    )


@query("group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def group_having(spark, sf_dir):
    return R.group(table(spark, sf_dir, "orders"), ["o_custkey"], F.count(F.lit(1)).alias("n"), having=F.col("n") > 12)


@query("group_composite", "SELECT year(o_orderdate)::INT AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def group_composite(spark, sf_dir):
    return R.group(table(spark, sf_dir, "orders"), [F.year("o_orderdate").alias("y"), "o_orderstatus"], F.count(F.lit(1)).alias("n"))


@query("join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_inner(spark, sf_dir):
    o, c, n = t(spark, sf_dir, "orders", "customer", "nation")
    return R.join(R.join(o, c, "o_custkey", "c_custkey"), n, "c_nationkey", "n_nationkey").select("o_orderkey", "c_name", "n_name")


@query("join_left", "SELECT c_custkey, o_orderkey, coalesce(o_orderstatus, '-') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_left(spark, sf_dir):
    return left_orders(*t(spark, sf_dir, "customer", "orders"))


def left_orders(c, o):
    return R.join(c, o, "c_custkey", "o_custkey", "left").select("c_custkey", "o_orderkey", F.coalesce("o_orderstatus", F.lit("-")).alias("status"))


@query("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(spark, sf_dir):
    """The sides are swapped: customers without orders are the right rows that nothing matches."""
    c, o = t(spark, sf_dir, "customer", "orders")
    return R.join(o, c, "o_custkey", "c_custkey", "right").select("c_custkey", "o_orderkey")


@query("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def join_full(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer", "supplier")
    return R.join(c, s, "c_custkey", "s_suppkey", "outer").select("c_custkey", "s_suppkey")


@query("join_composite", "SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus WHERE a.o_orderkey < b.o_orderkey")
def join_composite(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return order_pairs(o, o)


def order_pairs(a, b):
    a, b = a.toDF("a_key", "a_cust", "a_status"), b.toDF("b_key", "b_cust", "b_status")
    return R.join(a, b, ["a_cust", "a_status"], ["b_cust", "b_status"]).filter("a_key < b_key").select("a_key", "b_key")


@query("group_join", "SELECT c_custkey, coalesce(n, 0) AS n, last_key FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def group_join(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    joined = R.group_join(c, o, "c_custkey", "o_custkey", F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "last_key")


RANKS = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
COARSE = "PARTITION BY o_custkey ORDER BY o_orderpriority"


@query("window_ranks", f"""SELECT o_orderkey, row_number() OVER ({RANKS}) AS rn, rank() OVER ({COARSE}) AS rk, dense_rank() OVER ({COARSE}) AS dr, round(percent_rank() OVER ({COARSE}), 9) AS pr, ntile(3) OVER ({RANKS}) AS nt FROM orders""")
def window_ranks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    fine = R.with_window(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], lambda w: {"rn": w.row_number(), "nt": w.ntile(3)})
    coarse = R.with_window(fine, ["o_custkey"], [F.col("o_orderpriority")], lambda w: {"rk": w.rank(), "dr": w.dense_rank(), "pr": F.round(w.percent_rank(), 9)})
    return coarse.select("o_orderkey", "rn", "rk", "dr", "pr", "nt")


@query("window_lag_lead", "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def window_lag_lead(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return R.with_window(e, ["user_id"], [F.col("event_id")], lambda w: {"before": w.lag("value"), "after": w.lead("value", 2)}).select("event_id", "before", "after")


@query("window_running", """SELECT event_id, sum(cast(value AS DECIMAL(14,2))) OVER w::DOUBLE AS total, count(*) OVER w AS n, min(value) OVER w AS low, max(value) OVER w AS high,
round((avg(cast(value AS DECIMAL(14,2))) OVER w)::DOUBLE, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def window_running(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("value").cast(MONEY).alias("m"))
    run = lambda w: {
        "total": w.sum("m").cast("double"), "n": w.count(), "low": w.min("value"), "high": w.max("value"), "mean": F.round(w.sum("m").cast("double") / w.count(), 6),
    }
    return R.with_window(e, ["user_id"], [F.col("event_id")], run).select("event_id", "total", "n", "low", "high", "mean")


@query("window_total", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation")
def window_total(spark, sf_dir):
    return R.with_window(table(spark, sf_dir, "nation"), ["n_regionkey"], [], lambda w: {"n": w.count()}).select("n_nationkey", "n")


@query("with_row_number", "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS row_number, rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rank FROM nation")
def with_row_number(spark, sf_dir):
    n = R.with_row_number(table(spark, sf_dir, "nation"), ["n_regionkey"], [F.col("n_nationkey").desc()])
    return R.with_rank(n, ["n_regionkey"], [F.col("n_name")]).select("n_nationkey", "row_number", "rank")


def keys(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer", "supplier")
    return c.filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), s.filter("s_acctbal < 6000").select(F.col("s_nationkey").alias("k"))


A_B = ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 6000")


@query("set_union", " UNION ALL ".join(A_B))
def set_union(spark, sf_dir):
    return S.union(*keys(spark, sf_dir))


@query("set_union_distinct", " UNION ".join(A_B))
def set_union_distinct(spark, sf_dir):
    return S.union_distinct(*keys(spark, sf_dir))


@query("set_intersect", " INTERSECT ".join(A_B))
def set_intersect(spark, sf_dir):
    return S.intersect(*keys(spark, sf_dir))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer", "orders")
    return S.except_(c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")))


@query("math_scalars", """SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice) AS r, round_even(p_size / 2.0, 0)::DOUBLE AS e, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f, round(sqrt(p_size), 9) AS s, pow(p_size, 2) AS p, p_size // 7 AS d, p_size % 3 = 0 AS m FROM part""")
def math_scalars(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.abs(F.col("p_size") - 25).alias("a"), N.round_half_up("p_retailprice").alias("r"), N.round_half_even(F.col("p_size") / 2.0).alias("e"), F.ceil("p_retailprice").alias("c"),
        F.floor("p_retailprice").alias("f"), F.round(F.sqrt("p_size"), 9).alias("s"), F.pow("p_size", F.lit(2)).alias("p"), N.int_div("p_size", 7).cast("int").alias("d"), N.is_multiple("p_size", 3).alias("m"),
    )


@query("string_scalars", """SELECT p_partkey, length(p_name) AS n, contains(p_name, 'ring') AS c, starts_with(p_name, 's') AS s, ends_with(p_name, 't') AS e, upper(p_name) AS u, lower(p_type) AS l, trim('  ' || p_brand || ' ') AS t,
substr(p_name, 3, 4) AS sub, instr(p_name, 'e') - 1 AS i, replace(p_name, 'e', '3') AS r, p_name || '/' || p_brand AS j FROM part""")
def string_scalars(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.length("p_name").cast("long").alias("n"), c("p_name").contains("ring").alias("c"), c("p_name").startswith("s").alias("s"), c("p_name").endswith("t").alias("e"), F.upper("p_name").alias("u"),
        F.lower("p_type").alias("l"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("t"), X.substring("p_name", 2, 4).alias("sub"), X.index_of("p_name", "e").cast("long").alias("i"),
        F.replace("p_name", F.lit("e"), F.lit("3")).alias("r"), X.plus("p_name", F.lit("/"), "p_brand").alias("j"),
    )


@query("date_parts", """SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS mo, day(o_orderdate)::INT AS d, hour(o_orderdate)::INT AS h, minute(o_orderdate)::INT AS mi, second(o_orderdate)::INT AS s,
dayofweek(o_orderdate)::INT AS w, dayofyear(o_orderdate)::INT AS dy, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS later FROM orders""")
def date_parts(spark, sf_dir):
    d = "o_orderdate"
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("mo"), F.dayofmonth(d).alias("d"), F.hour(d).alias("h"), F.minute(d).alias("mi"), F.second(d).alias("s"),
        N.day_of_week(d).alias("w"), F.dayofyear(d).alias("dy"), F.date_format(N.add_days(F.col(d), 10), "yyyy-MM-dd").alias("later"),
    )


@query("null_handling", "SELECT c_custkey, o_orderkey IS NULL AS none, coalesce(o_orderstatus, 'none') AS s, 'x' || coalesce(o_orderstatus, '') AS p, o_orderstatus IS NOT DISTINCT FROM NULL AS same FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def null_handling(spark, sf_dir):
    return nulls_of(*t(spark, sf_dir, "customer", "orders"))


def nulls_of(c, o):
    j, s = R.join(c, o, "c_custkey", "o_custkey", "left"), F.col("o_orderstatus")
    return j.select("c_custkey", F.col("o_orderkey").isNull().alias("none"), F.coalesce(s, F.lit("none")).alias("s"), X.plus(F.lit("x"), s).alias("p"), X.equals(s, None).alias("same"))


@query("in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o_orderstatus IN ('F')")
def in_list(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("F")).select("o_orderkey")


@query("conditional", "SELECT p_partkey, CASE WHEN p_size > 25 AND p_retailprice >= 1000 THEN 'big' WHEN p_size <= 5 OR p_brand <> 'Brand#1' THEN 'other' ELSE 'one' END AS kind, p_size + 1 - 2 * 3 AS arith FROM part")
def conditional(spark, sf_dir):
    c = F.col
    kind = F.when((c("p_size") > 25) & (c("p_retailprice") >= 1000), "big").when((c("p_size") <= 5) | (c("p_brand") != "Brand#1"), "other").otherwise("one")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), (c("p_size") + 1 - F.lit(2) * 3).alias("arith"))


@query("array_functions", """SELECT vec_id, list_bool_or(list_transform(embedding, lambda x: x > 0.2)) AS some, list_bool_and(list_transform(embedding, lambda x: x > -0.9)) AS every, len(list_filter(embedding, lambda x: x > 0)) AS n_positive,
round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2)), 4) AS doubled FROM embeddings""")
def array_functions(spark, sf_dir):
    e = F.col("embedding")
    doubled = F.aggregate(F.transform(e, lambda x: x.cast("double") * 2), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.exists(e, lambda x: x > F.lit(0.2).cast("float")).alias("some"), F.forall(e, lambda x: x > F.lit(-0.9).cast("float")).alias("every"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("n_positive"), F.round(doubled, 4).alias("doubled"),
    )


@query("array_select_many", "SELECT label, count(*) AS n FROM (SELECT label, unnest(embedding) AS x FROM embeddings) WHERE x > 0.1::FLOAT GROUP BY label")
def array_select_many(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x")).filter(F.col("x") > F.lit(0.1).cast("float"))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("json_props", "SELECT event_id, cast(props->>'k' AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("nested_property", "SELECT c_custkey, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def nested_property(spark, sf_dir):
    c, n, r = t(spark, sf_dir, "customer", "nation", "region")
    both = R.join(n, r, "n_regionkey", "r_regionkey").select("n_nationkey", F.struct("n_name", F.struct("r_name").alias("region")).alias("address"))
    return R.join(c, both, "c_nationkey", "n_nationkey").select("c_custkey", F.col("address.n_name").alias("nation"), F.col("address.region.r_name").alias("region"))


UPDATES = "(SELECT c_custkey + CASE WHEN c_custkey % 20 = 0 THEN 1000000 ELSE 0 END AS c_custkey, 'new ' || c_name AS c_name, 3 AS c_nationkey, 1.5::DOUBLE AS c_acctbal, 'X' AS c_mktsegment FROM customer WHERE c_custkey % 10 = 0)"


def updates(c):
    return c.filter("c_custkey % 10 = 0").select(
        (F.col("c_custkey") + F.when(F.col("c_custkey") % 20 == 0, 1000000).otherwise(0)).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), F.lit(3).alias("c_nationkey"),
        F.lit(1.5).alias("c_acctbal"), F.lit("X").alias("c_mktsegment"),
    )


@query("merge_upsert", f"SELECT coalesce(u.c_custkey, c.c_custkey) AS c_custkey, coalesce(u.c_name, c.c_name) AS c_name, coalesce(u.c_nationkey, c.c_nationkey) AS c_nationkey, coalesce(u.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(u.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN {UPDATES} u ON c.c_custkey = u.c_custkey")
def merge_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return M.upserted(c, updates(c), "c_custkey")


@query("merge_update_only", f"SELECT c.c_custkey, c.c_name, c.c_nationkey, coalesce(u.c_acctbal, c.c_acctbal) AS c_acctbal, c.c_mktsegment FROM customer c LEFT JOIN {UPDATES} u ON c.c_custkey = u.c_custkey")
def merge_update_only(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return M.upserted(c, updates(c), "c_custkey", only=["c_acctbal"], insert=False)


@query("sql_query", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def sql_query(spark, sf_dir):
    return spark.sql("SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY 1", nation=table(spark, sf_dir, "nation"))


@query("auto_udf", "SELECT n_nationkey, n_nationkey * 10 + n_regionkey AS code FROM nation")
def auto_udf(spark, sf_dir):
    from sluice.functions.udf import on_entity

    def code(n_nationkey, n_regionkey):
        return n_nationkey * 10 + n_regionkey

    return table(spark, sf_dir, "nation").select("n_nationkey", on_entity(code, "int").alias("code"))
