"""Queries that go through files and streams first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.operators.storage import scratch
from sluice.plans.registry import query, table
from sluice.sources import files, writers
from sluice.sources.errors import Action
from sluice.sources.yaml_source import YamlOptions, rows_of, bound
from sluice.streaming import streams

NATION = "n_nationkey int, n_name string, n_regionkey int"
ALL_NATIONS = "SELECT * FROM nation"
# A small CSV with the faults that the reader knows: a field too many, one too few, a number that is none.
FAULTY = "id,name,amount\n1,Ann,10.5\n2,Bob,x\n3,Cy\n4,Di,7,extra\n5,\"Eve, E\",8\n"


def schema(ddl: str):
    from pyspark.sql import types as T

    return T._parse_datatype_string(ddl)


@query("csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    writers.csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return files.csv(spark, f"{path}/*.csv", files.CsvOptions(schema=schema("o_orderkey bigint, o_orderstatus string, o_totalprice double"))).df


@query("csv_inferred", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_inferred(spark, sf_dir):
    path = scratch(spark, "csv")
    writers.csv(table(spark, sf_dir, "nation").coalesce(1), path)
    return files.csv(spark, f"{path}/*.csv", files.CsvOptions(infer_schema=True)).df


@query("csv_errors", "SELECT * FROM (VALUES (1::BIGINT, 'Ann', 10.5::DOUBLE), (2, 'Bob', NULL), (3, 'Cy', NULL), (5, 'Eve, E', 8.0)) AS v(id, name, amount)")
def csv_errors(spark, sf_dir):
    return files.csv_text(spark, FAULTY, files.CsvOptions(schema=schema("id bigint, name string, amount double"), action=Action.SKIP)).df


@query("csv_error_rows", "SELECT 'SchemaError' AS error_type, 5::BIGINT AS record_number, 'Skip' AS action_chosen")
def csv_error_rows(spark, sf_dir):
    return files.csv_text(spark, FAULTY, files.CsvOptions(action=Action.SKIP)).errors.select("error_type", "record_number", "action_chosen")


@query("csv_stop", "SELECT * FROM (VALUES ('1', 'Ann', '10.5'), ('2', 'Bob', 'x'), ('3', 'Cy', NULL)) AS v(id, name, amount)")
def csv_stop(spark, sf_dir):
    return files.csv_text(spark, FAULTY, files.CsvOptions(action=Action.STOP)).df


@query("csv_lines", "SELECT n_nationkey, cast(n_nationkey AS VARCHAR) || ',' || n_name || ',' || cast(n_regionkey AS VARCHAR) AS line FROM nation")
def csv_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", writers.csv_line(n.columns).alias("line"))


@query("json_round_trip", ALL_NATIONS)
def json_round_trip(spark, sf_dir):
    path = scratch(spark, "json")
    whole = table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    whole.coalesce(1).write.text(path)
    return files.json_documents(spark, f"{path}/*.txt", files.JsonOptions(schema=schema(NATION))).df


@query("ndjson_round_trip", "SELECT event_id, event_type, value FROM events")
def ndjson_round_trip(spark, sf_dir):
    path = scratch(spark, "ndjson")
    writers.json_(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path, writers.JsonWriteOptions(lines=True))
    return files.ndjson(spark, path, schema("event_id bigint, event_type string, value double"))


@query("yaml_round_trip", ALL_NATIONS)
def yaml_round_trip(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    item = F.concat(F.lit("- n_nationkey: "), F.col("n_nationkey").cast("string"), F.lit("\n  N_Name: "), "n_name", F.lit("\n  n_regionkey: "), F.col("n_regionkey").cast("string"), F.lit("\n  more: 1\n"))
    text = n.groupBy((F.col("n_nationkey") % 3).alias("f")).agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("t"))
    docs = text.select(F.col("f").cast("string").alias("_file"), F.encode("t", "utf-8").alias("content"))
    options = YamlOptions(schema=schema(NATION))
    return bound(rows_of(docs, options), options).df


@query("text_lines", "SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS value FROM documents")
def text_lines(spark, sf_dir):
    return lines_of(spark, table(spark, sf_dir, "documents"))


def lines_of(spark, docs):
    path = scratch(spark, "text")
    writers.text(docs, path, value="text")
    return files.text(spark, path).select("value")


@query("orc_round_trip", ALL_NATIONS)
def orc_round_trip(spark, sf_dir):
    path = scratch(spark, "orc")
    writers.orc(table(spark, sf_dir, "nation"), path, partition_by=["n_regionkey"])
    return spark.read.orc(path).select("n_nationkey", "n_name", "n_regionkey")


@query("stream_unify", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'clicks' ELSE 'errors' END AS _source FROM events WHERE event_type IN ('click', 'error')")
def stream_unify(spark, sf_dir):
    from sluice.operators.sets import Unified

    stream = lambda: streams.read_files(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    both = Unified().unify(stream(), "clicks", F.col("event_type") == "click").unify(stream(), "errors", F.col("event_type") == "error").read()
    path, done = scratch(spark, "stream"), scratch(spark, "offsets")
    query_ = both.select("event_id", "_source").writeStream.format("parquet").option("path", path).option("checkpointLocation", done).trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(path)


@query("stream_cases", "SELECT CASE WHEN value > 100 THEN 'large' ELSE 'small' END AS sink, count(*) AS n FROM events GROUP BY 1")
def stream_cases(spark, sf_dir):
    from sluice.operators import cases as C

    e = streams.read_files(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema).select("event_id", "value")
    path, done = scratch(spark, "stream"), scratch(spark, "offsets")
    put = lambda name: lambda rows: rows.select("event_id").write.mode("append").parquet(f"{path}/{name}")
    streams.case_sinks(C.cases(e, F.col("value") > 100), put("large"), put("small"), checkpoint=done).awaitTermination()
    counts = [spark.read.parquet(f"{path}/{k}").agg(F.lit(k).alias("sink"), F.count(F.lit(1)).alias("n")) for k in ("large", "small")]
    return counts[0].unionByName(counts[1])


@query("stream_poll", "SELECT unnest(range(0, 6)) AS n, 'tick' AS what")
def stream_poll(spark, sf_dir):
    """A polled source to its end: six ticks, three for each poll."""
    source = streams.poll_source(spark, f"ticks_{uuid.uuid4().hex[:8]}", lambda n: [(n + k, "tick") for k in range(3)] if n < 6 else [], "n bigint, what string")
    path, done = scratch(spark, "stream"), scratch(spark, "offsets")
    query_ = source.writeStream.format("parquet").option("path", path).option("checkpointLocation", done).trigger(processingTime="200 milliseconds").start()
    query_.processAllAvailable()
    query_.stop()
    return spark.read.schema("n bigint, what string").parquet(path)
