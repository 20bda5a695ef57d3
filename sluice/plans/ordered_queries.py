"""Queries of projection, slicing, ordered merging and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import aggregate as A
from sluice.operators import project as P
from sluice.operators import sets as S
from sluice.operators import slicing as L
from sluice.operators.parallel import as_parallel
from sluice.plans.registry import query, table

EVENT = ["event_id"]
E_COLS = "event_id, user_id, value"
POS = "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value")


@query("filter_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'A'")
def filter_project(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") > 40) & (F.col("l_returnflag") == "A"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("doubled"))


@query("indexed_select", "SELECT n_name || '#' || cast(n_nationkey AS VARCHAR) AS label, row_number() OVER (ORDER BY n_nationkey) - 1 AS idx FROM nation")
def indexed_select(spark, sf_dir):
    label = lambda p: F.concat("n_name", F.lit("#"), F.col("n_nationkey").cast("string")).alias("label")
    return P.select_indexed(table(spark, sf_dir, "nation"), ["n_nationkey"], label, lambda p: p.alias("idx"))


@query("indexed_where", f"SELECT {E_COLS} FROM {POS} WHERE p % 3 = 1")
def indexed_where(spark, sf_dir):
    return P.where_indexed(events(spark, sf_dir), EVENT, lambda p: p % 3 == 1)


@query("select_many", "SELECT doc_id, unnest(string_split(text, ' ')) AS item FROM documents")
def select_many(spark, sf_dir):
    return P.select_many(table(spark, sf_dir, "documents"), F.split("text", " ", -1), keep=("doc_id",))


@query("select_many_indexed", "SELECT vec_id, i - 1 AS index, (embedding[i]::DOUBLE * p)::DOUBLE AS item FROM (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings), LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)")
def select_many_indexed(spark, sf_dir):
    scaled = lambda p: F.transform("embedding", lambda x: x.cast("double") * p)
    return P.select_many_indexed(table(spark, sf_dir, "embeddings"), ["vec_id"], scaled, keep=("vec_id",))


@query("flatten", "SELECT vec_id, i - 1 AS index, embedding[i]::DOUBLE AS item FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)")
def flatten(spark, sf_dir):
    return P.flatten(table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", keep=("vec_id",))


@query("flatten_separator", """SELECT doc_id, i - 1 AS index, l[i] AS item FROM (SELECT doc_id, list_append(CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END, '--') AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)""")
def flatten_separator(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    return P.flatten(docs, "lines", F.lit("--"), keep=("doc_id",))


@query("append_prepend", "SELECT r_regionkey, r_name, 1 AS side FROM region UNION ALL SELECT 98, 'LAST', 2 UNION ALL SELECT 99, 'FIRST', 0")
def append_prepend(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    row = lambda k, n: spark.createDataFrame([(k, n)], region.schema)
    last = P.append(region, row(98, "LAST"), ["r_regionkey"]).filter("_order.side = 2")
    return P.prepend(region, row(99, "FIRST"), ["r_regionkey"]).unionByName(last).select("r_regionkey", "r_name", F.col("_order.side").alias("side"))


@query("to_lines", """SELECT doc_id, g AS line_no, coalesce(string_agg(w, '' ORDER BY p) FILTER (w <> 'the'), '') AS line FROM (
  SELECT *, cast(sum(cast(w = 'the' AS INT)) OVER (PARTITION BY doc_id ORDER BY p) - cast(w = 'the' AS INT) AS BIGINT) AS g FROM (
    SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents)) GROUP BY doc_id, g HAVING bool_or(w = 'the')""")
def to_lines(spark, sf_dir):
    return lines_by_the(table(spark, sf_dir, "documents"))


@query("to_lines_whole", """SELECT g AS line_no, coalesce(string_agg(w, '' ORDER BY doc_id, p) FILTER (w <> 'the'), '') AS line FROM (
  SELECT *, cast(sum(cast(w = 'the' AS INT)) OVER (ORDER BY doc_id, p) - cast(w = 'the' AS INT) AS BIGINT) AS g FROM (
    SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents)) GROUP BY g HAVING bool_or(w = 'the')""")
def to_lines_whole(spark, sf_dir):
    """All texts as one sequence of slices, without a partition."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("p", "w"))
    return P.to_lines(words, "w", "the", ["doc_id", "p"])


def lines_by_the(docs):
    words = docs.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("p", "w"))
    return P.to_lines(words, "w", "the", ["p"], ("doc_id",))


@query("buffer_chunks", "SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders) GROUP BY chunk")
def buffer_chunks(spark, sf_dir):
    chunks = P.buffer(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 1000)
    return chunks.select("chunk", F.size("items").cast("long").alias("n"), F.expr("items[0].o_orderkey").alias("first_key"), F.expr("element_at(items, -1).o_orderkey").alias("last_key"))


@query("take", f"SELECT {E_COLS} FROM events ORDER BY event_id LIMIT 25")
def take(spark, sf_dir):
    return L.take(events(spark, sf_dir), EVENT, 25)


@query("take_slice", f"SELECT {E_COLS} FROM events ORDER BY event_id LIMIT 20 OFFSET 100")
def take_slice(spark, sf_dir):
    return L.take_slice(events(spark, sf_dir), EVENT, 100, 20)


@query("take_range", f"SELECT {E_COLS} FROM events ORDER BY event_id LIMIT 30 OFFSET 10")
def take_range(spark, sf_dir):
    return L.take_range(events(spark, sf_dir), EVENT, slice(10, 40))


@query("skip", f"SELECT {E_COLS} FROM {POS} WHERE p >= 900")
def skip(spark, sf_dir):
    return L.skip(events(spark, sf_dir), EVENT, 900)


@query("take_while", f"SELECT {E_COLS} FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE NOT value < 300)")
def take_while(spark, sf_dir):
    return L.take_while(events(spark, sf_dir), EVENT, F.col("value") < 300)


@query("skip_while", f"SELECT {E_COLS} FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE NOT value < 300)")
def skip_while(spark, sf_dir):
    return L.skip_while(events(spark, sf_dir), EVENT, F.col("value") < 300)


@query("skip_while_indexed", f"SELECT {E_COLS} FROM {POS} WHERE p >= 500")
def skip_while_indexed(spark, sf_dir):
    return L.skip_while_indexed(events(spark, sf_dir), EVENT, lambda p: p < 500)


@query("until_inclusive", f"SELECT {E_COLS} FROM events WHERE event_id <= coalesce((SELECT min(event_id) FROM events WHERE value > 300), 9223372036854775807)")
def until_inclusive(spark, sf_dir):
    return L.until(events(spark, sf_dir), EVENT, F.col("value") > 300)


@query("until_indexed", f"SELECT {E_COLS} FROM {POS} WHERE p <= 77")
def until_indexed(spark, sf_dir):
    return L.until_indexed(events(spark, sf_dir), EVENT, lambda p: p >= 77)


@query("until_index", f"SELECT {E_COLS} FROM {POS} WHERE p <= 41")
def until_index(spark, sf_dir):
    return L.until_index(events(spark, sf_dir), EVENT, 41)


@query("first_match", f"SELECT {E_COLS} FROM events WHERE value > 200 ORDER BY event_id LIMIT 1")
def first_match(spark, sf_dir):
    return L.take(events(spark, sf_dir).filter("value > 200"), EVENT, 1)


@query("concat", "SELECT n_name AS name, 0 AS _src FROM nation UNION ALL SELECT r_name, 1 FROM region")
def concat(spark, sf_dir):
    return S.concat(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@query("distinct_first", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def distinct_first(spark, sf_dir):
    return S.distinct_first(table(spark, sf_dir, "events").select("event_id", "event_type"), EVENT, F.lower("event_type")).select("event_type", "event_id")


@query("merge_ordered", """SELECT o_orderkey, src, row_number() OVER (ORDER BY o_custkey, src, o_orderkey) - 1 AS place FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS src FROM orders)""")
def merge_ordered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    merged = S.merge_ordered(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey"], "place", ["o_orderkey"])
    return merged.select("o_orderkey", F.col("_src").alias("src"), "place")


@query("unify_sources", "SELECT event_id, 'clicks' AS _source FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'large' FROM events WHERE value > 100")
def unify_sources(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    both = S.Unified().unify(e, "clicks", F.col("event_type") == "click").unify(e, "gone").unify(e, "large", F.col("value") > 100)
    both.unlisten("gone")
    return both.read().select("event_id", "_source")


@query("unify_round_robin", """SELECT o_orderkey, row_number() OVER (ORDER BY turn, s) - 1 AS place FROM (SELECT o_orderkey, s, row_number() OVER (PARTITION BY s ORDER BY o_orderkey) - 1 AS turn
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS s FROM orders))""")
def unify_round_robin(spark, sf_dir):
    from sluice.operators.ordering import positions

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    both = S.unify((o.filter("o_orderstatus = 'F'"), "f"), o.filter("o_orderstatus <> 'F'"), "rest")
    return positions(both.read(["o_orderkey"]), ["_turn", "_rank"], "place").select("o_orderkey", "place")


@query("aggregate_sums", """SELECT sum(l_linenumber)::INT AS i, sum(l_partkey)::BIGINT AS l, sum(cast(l_extendedprice AS DECIMAL(14,2)))::DOUBLE AS d, bool_or(l_quantity > 49) AS any_large, count(*) FILTER (l_quantity > 49) AS n_large FROM lineitem""")
def aggregate_sums(spark, sf_dir):
    q = F.col("l_quantity") > 49
    return table(spark, sf_dir, "lineitem").agg(
        A.sum_int(F.col("l_linenumber")).alias("i"), A.sum_long(F.col("l_partkey")).alias("l"), A.sum_decimal(F.col("l_extendedprice")).cast("double").alias("d"),
        F.bool_or(q).alias("any_large"), F.count_if(q).alias("n_large"),
    )


@query("fold", "SELECT n_regionkey, list_reduce(list_prepend(7::BIGINT, list(n_nationkey::BIGINT ORDER BY n_nationkey)), lambda a, x: (a * 31 + x) % 1000003) AS result FROM nation GROUP BY n_regionkey")
def fold(spark, sf_dir):
    step = lambda a, x: (a * 31 + x) % 1000003
    return A.fold(table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("long"), ["n_nationkey"], F.lit(7).cast("long"), step, ("n_regionkey",))


@query("fold_first", "SELECT n_regionkey, list_reduce(list(n_nationkey::BIGINT ORDER BY n_nationkey), lambda a, x: (a * 3 - x)) AS result FROM nation GROUP BY n_regionkey")
def fold_first(spark, sf_dir):
    return A.fold_first(table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("long"), ["n_nationkey"], lambda a, x: a * 3 - x, ("n_regionkey",))


@query("build_string", "SELECT n_regionkey, '{' || string_agg(n_name, ', ' ORDER BY n_nationkey) || '}' AS text FROM nation GROUP BY n_regionkey")
def build_string(spark, sf_dir):
    return A.build_string(table(spark, sf_dir, "nation"), F.col("n_name"), ["n_nationkey"], group=("n_regionkey",))


@query("to_dictionary", "SELECT n_nationkey AS key, n_name AS value FROM nation")
def to_dictionary(spark, sf_dir):
    return A.to_map(table(spark, sf_dir, "nation"), "n_nationkey", "n_name").select(F.explode("map"))


@query("parallel_query", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'O'")
def parallel_query(spark, sf_dir):
    p = as_parallel(table(spark, sf_dir, "orders")).with_max_concurrency(4).with_order_preservation("o_orderkey").with_buffer_size(5)
    return p.where("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice")).plan()
