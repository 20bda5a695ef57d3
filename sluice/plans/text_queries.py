"""Queries of the text layer and the schema binder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import parsing as I
from sluice.functions import text as X
from sluice.functions import tokenizer as K
from sluice.plans.registry import query, table
from sluice.schema.bind import bind

SAMPLES = ["1.234,56", "1,234.56", "1.234", "1,234", "1.234.567", "12,5", "0.99", "-1 234,50", "abc", "12", "1,2.3,4", "", None]
# SAMPLES read by hand; null where the mark is in doubt or there is none.
READ = [1234.56, 1234.56, None, None, 1234567.0, 12.5, 0.99, -1234.5, None, None, None, None, None]
TEXTS = ["true", "12", "007", "3000000000", "12345678901234567890", "1.5", "2024-02-03", "0F8FAD5B-D9CB-469F-A165-70867728950E", "word", "", "False", "-5"]
TAGS = ["boolean", "int", "string", "long", "string", "decimal", "timestamp", "guid", "string", "string", "boolean", "int"]


def values(rows: list, kinds: list[str]) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    casts = ", ".join(f"CAST(c{k} AS {kind}) AS {name}" for k, (name, kind) in enumerate(zip(("id", "text", "out"), kinds, strict=False)))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({', '.join(f'c{k}' for k in range(len(kinds)))})"


def local(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


@query("smart_decimal", values([(k, t, v) for k, (t, v) in enumerate(zip(SAMPLES, READ, strict=True))], ["BIGINT", "VARCHAR", "DOUBLE"]))
def smart_decimal(spark, sf_dir):
    return local(spark, SAMPLES).select("id", "text", I.smart_decimal("text").cast("double").alias("out"))


@query("infer_types", values([(k, t, v) for k, (t, v) in enumerate(zip(TEXTS, TAGS, strict=True))], ["BIGINT", "VARCHAR", "VARCHAR"]))
def infer_types(spark, sf_dir):
    return local(spark, TEXTS).select("id", "text", I.infer("text")["tag"].alias("out"))


@query("all_digits", "SELECT p_partkey, regexp_full_match(p_name, '[0-9]+') AS name, regexp_full_match(cast(p_size AS VARCHAR), '[0-9]+') AS size, try_cast(p_brand AS INT) AS n FROM part")
def all_digits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.is_all_digits("p_name").alias("name"), X.is_all_digits(F.col("p_size").cast("string")).alias("size"), I.try_parse("p_brand", "int").alias("n"))


@query("string_helpers", """SELECT doc_id, coalesce(starts_with(text, 'T') AND ends_with(text, '.'), false) AS between, coalesce(starts_with(text, 'An') OR starts_with(text, 'Of'), false) AS any_start, coalesce(contains(text, ' the ') OR contains(text, 'ing'), false) AS any_in,
substr(text, 1, 4) || '##' || substr(text, 6) AS replaced, CASE WHEN length(text) > 7 THEN substr(text, 3, 5) END AS part, CASE WHEN text <> '' THEN length(text) - 1 END AS last, false AS empty_token FROM documents""")
def string_helpers(spark, sf_dir):
    """An empty text has no last index."""
    return helped(table(spark, sf_dir, "documents"), F.when(F.col("text") != "", X.last_idx("text")))


def helped(docs, last):
    return docs.select(
        "doc_id", X.is_between("text", "T", ".").alias("between"), X.starts_with_any("text", ["An", "Of"]).alias("any_start"), X.contains_any("text", [" the ", "ing"]).alias("any_in"),
        X.replace_at("text", 3, 2, "##").alias("replaced"), X.sub_part("text", 2, 7).alias("part"), last.cast("long").alias("last"), X.contains_any("text", ["", "a"]).alias("empty_token"),
    )


@query("tokenize_extract", "SELECT page_id, unnest(regexp_extract_all(url, '([a-z]+)[:./]', 1)) AS part FROM pages")
def tokenize_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(K.extracted(F.col("url"), "([a-z]+)[:./]")).alias("part"))


URL = K.Tokenizer(r"^(?P<scheme>https?)://(?P<host>[^/]+)(?P<path>/[^?#]*)?")


@query("tokenize", """SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)?', 1) AS path FROM pages""")
def tokenize(spark, sf_dir):
    tokens = table(spark, sf_dir, "pages").select("page_id", URL.tokenize(F.col("url")).alias("t"))
    part = lambda name: F.coalesce(F.get(F.filter("t", lambda x: x["group_name"] == name), F.lit(0))["subpart"], F.lit("")).alias(name)
    return tokens.select("page_id", part("scheme"), part("host"), part("path"))


@query("tokens_flat", "SELECT page_id, count_groups AS n FROM (SELECT page_id, 4 + cast(regexp_matches(url, '^https?://[^/]+/') AS BIGINT) + cast(regexp_matches(url, '[?#]') AS BIGINT) AS count_groups FROM pages)")
def tokens_flat(spark, sf_dir):
    return K.tokens_flat(table(spark, sf_dir, "pages"), URL, "url", ["page_id"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("tokens_rebuilt", "SELECT page_id, regexp_replace(url, '^(https?://)[^/]+', '\\1HOST') AS url FROM pages")
def tokens_rebuilt(spark, sf_dir):
    tokens = table(spark, sf_dir, "pages").select("page_id", URL.tokenize(F.col("url")).alias("t"))
    return tokens.select("page_id", K.rebuilt(F.col("t"), {"host": lambda s: F.lit("HOST")}).alias("url"))


@query("resolve_schema", "SELECT c_custkey AS customer_key, c_name AS customer_name, c_nationkey AS nation_key, c_acctbal AS balance FROM customer")
def resolve_schema(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("CustomerKey"), F.col("c_name").alias("customer name"), F.col("c_nationkey").cast("string").alias("NATION_KEY"), F.col("c_acctbal").cast("string").alias("balanc")
    )
    schema = T.StructType([T.StructField("customer_key", T.LongType()), T.StructField("customer_name", T.StringType()), T.StructField("nation_key", T.IntegerType()), T.StructField("balance", T.DoubleType())])
    return bind(raw, schema)
