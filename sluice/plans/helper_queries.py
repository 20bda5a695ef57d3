"""Queries of terminals, settings, sinks, binding and the smaller helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import session, support
from sluice.flow import flow
from sluice.functions import parsing as I
from sluice.functions import scalars as N
from sluice.functions import text as X
from sluice.functions import tokenizer as K
from sluice.operators import aggregate as A
from sluice.operators import cases as C
from sluice.operators import inspect as V
from sluice.operators import merge as M
from sluice.operators import sets as S
from sluice.operators import slicing as L
from sluice.operators.parallel import as_parallel, cancellable
from sluice.operators.storage import scratch
from sluice.plans.registry import query, table
from sluice.schema import bind as B
from sluice.sources import errors as E
from sluice.sources import files, writers
from sluice.sources import yaml_source as Y
from sluice.streaming import streams

NATIONS = "SELECT * FROM nation"
BAND = "CASE WHEN o_totalprice > 250000 THEN 0 WHEN o_totalprice > 100000 THEN 1 ELSE 2 END"


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def name_of(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:8]}"


def settled(df, label: str):
    """df as files of the shared store: what it is read from may go."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local(spark, rows, ddl: str):
    return spark.createDataFrame(rows, ddl)


def bands(df):
    return C.cases(df, F.col("o_totalprice") > 250000, F.col("o_totalprice") > 100000)


# Sources and sinks over whole tables


@query("csv_simple", "SELECT cast(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def csv_simple(spark, sf_dir):
    path = scratch(spark, "csv")
    writers.csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, writers.CsvWriteOptions(separator=";"))
    return files.csv_simple(spark, f"{path}/*.csv", ";")


@query("csv_column", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def csv_column(spark, sf_dir):
    """Records in a text column."""
    lines = table(spark, sf_dir, "orders").select(writers.csv_line(["o_orderkey", "o_custkey", "o_orderpriority"]).alias("line"))
    return lines.select(files.csv_column("line", "o_orderkey bigint, o_custkey bigint, o_orderpriority string").alias("v")).select("v.*")


@query("csv_header", "SELECT 'n_nationkey,n_name,n_regionkey' AS header")
def csv_header(spark, sf_dir):
    return local(spark, [(writers.csv_header(table(spark, sf_dir, "nation")),)], "header string")


def faulty_orders(spark, sf_dir) -> str:
    """All orders as CSV; every seventh record has a field too many."""
    o = table(spark, sf_dir, "orders")
    line = writers.csv_line(["o_orderkey", "o_orderstatus"])
    path = scratch(spark, "faulty")
    o.select(F.concat(line, F.when(F.col("o_orderkey") % 7 == 0, F.lit(",more")).otherwise(F.lit(""))).alias("value")).write.text(path)
    return path


FAULTY = "o_orderkey bigint, o_orderstatus string"


@query("csv_skips_faulty", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0")
def csv_skips_faulty(spark, sf_dir):
    return files.csv(spark, faulty_orders(spark, sf_dir), files.CsvOptions(schema=schema(FAULTY), header=False, action=E.Action.SKIP, multi_line=False)).df


@query("csv_reported", """SELECT count(*) FILTER (o_orderkey % 7 <> 0) AS emitted, count(*) FILTER (o_orderkey % 7 = 0) AS errors, count(*) FILTER (o_orderkey % 7 = 0) AS logged,
count(*) FILTER (o_orderkey % 7 = 0) AS called, count(*) AS progressed, false AS early FROM orders""")
def csv_reported(spark, sf_dir):
    """Error sinks, metrics and progress of one read: a log of JSON lines, a callback, and a sink that drops all."""
    metrics, calls, seen, log = E.Metrics(), [], [], scratch(spark, "log")
    o = files.CsvOptions(schema=schema(FAULTY), header=False, action=E.Action.SKIP, multi_line=False, sink=E.JsonLinesSink(log), on_error=lambda raw, e: calls.append(raw), metrics=metrics, progress=seen.append)
    result = files.csv(spark, faulty_orders(spark, sf_dir), o).finish()
    E.NullSink().report(result.errors)
    logged = spark.read.json(log).filter("errorType = 'SchemaError'").count()
    return local(spark, [(metrics.emitted, metrics.errors, logged, len(calls), seen[-1].records_read + seen[-1].error_count, metrics.terminated_early)], "emitted bigint, errors bigint, logged bigint, called bigint, progressed bigint, early boolean")


@query("csv_dead_letters", "SELECT 'SchemaError' AS error_type, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0")
def csv_dead_letters(spark, sf_dir):
    name = name_of("letters")
    files.csv(spark, faulty_orders(spark, sf_dir), files.CsvOptions(schema=schema(FAULTY), header=False, action=E.Action.SKIP, multi_line=False, sink=E.TableSink(name))).finish()
    out = settled(spark.table(name).groupBy("error_type").agg(F.count(F.lit(1)).alias("n")), "letters")
    spark.sql(f"DROP TABLE {name}")
    return out


@query("json_array_files", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_array_files(spark, sf_dir):
    """All orders written as arrays, a file for each task, and read by element."""
    path = scratch(spark, "arrays")
    writers.json_(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, writers.JsonWriteOptions(parts=True))
    return files.json_documents(spark, f"{path}/*.txt", files.JsonOptions(schema=schema("o_orderkey bigint, o_orderstatus string, o_totalprice double"))).df


@query("json_column", "SELECT o_custkey, o_orderkey FROM orders")
def json_column(spark, sf_dir):
    """Arrays in a text column, an element a row."""
    texts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct("o_orderkey"))).alias("text"))
    return texts.select("o_custkey", F.explode(files.json_column("text", schema("o_orderkey bigint"))).alias("v")).select("o_custkey", "v.o_orderkey")


@query("json_faults", "SELECT * FROM (VALUES ('JsonValidationFailed', 'Skip', 2::BIGINT), ('JsonException', 'Skip', 1)) AS v(error_type, action_chosen, n)")
def json_faults(spark, sf_dir):
    """Elements that a validator refuses or that don't fit: five of them, by hand."""
    o = files.JsonOptions(schema=schema("k bigint"), action=E.Action.SKIP, validator=F.col("k") > 0)
    errors = files.json_text(spark, '[{"k": 1}, {"k": -1}, {"k": "x"}, {"k": 0}, {"K": 5}]', o).errors
    return errors.groupBy("error_type", "action_chosen").agg(F.count(F.lit(1)).alias("n"))


@query("yaml_files", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def yaml_files(spark, sf_dir):
    """All customers written as YAML sequences by the tasks, and read by item."""
    path = scratch(spark, "yaml")
    writers.yaml_(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path, writers.YamlWriteOptions(parts=True))
    return Y.yaml_documents(spark, f"{path}/*.txt", Y.YamlOptions(schema=schema("c_custkey bigint, c_name string, c_acctbal double"))).df


@query("yaml_refused", "SELECT * FROM (VALUES ('alias', 'YamlSecurityError'), ('deep', 'YamlSecurityError'), ('tag', 'YamlSecurityError'), ('broken', 'YamlException')) AS v(what, error_type)")
def yaml_refused(spark, sf_dir):
    """What the filter of events refuses, by hand."""
    texts = {"alias": "- &a {k: 1}\n- *a\n", "deep": "[" * 70 + "]" * 70, "tag": "- !!python/object:os.system {}\n", "broken": "- {k: 1\n"}
    out = None
    for what, text in texts.items():
        one = Y.yaml_text(spark, text, Y.YamlOptions(schema=schema("k bigint"), action=E.Action.SKIP)).errors.select(F.lit(what).alias("what"), "error_type")
        out = one if out is None else out.unionByName(one)
    return out


@query("writers_counted", "SELECT count(*) AS text, count(*) AS csv, count(*) AS json, count(*) AS arrays, count(*) AS yaml FROM events")
def writers_counted(spark, sf_dir):
    """Rows that each writer says it has written."""
    e, got = table(spark, sf_dir, "events").select("event_id", "event_type"), []
    for write, kind, more in (
        (lambda p, o: writers.text(e, p, o, value="event_type"), writers.WriteOptions, {}), (lambda p, o: writers.csv(e, p, o), writers.CsvWriteOptions, {}),
        (lambda p, o: writers.json_(e, p, o), writers.JsonWriteOptions, {"lines": True}), (lambda p, o: writers.json_(e, p, o), writers.JsonWriteOptions, {"parts": True}),
        (lambda p, o: writers.yaml_(e, p, o), writers.YamlWriteOptions, {"parts": True}),
    ):
        m = E.Metrics()
        write(scratch(spark, "counted"), kind(metrics=m, **more))
        got.append(m.emitted)
    return local(spark, [tuple(got)], "text bigint, csv bigint, json bigint, arrays bigint, yaml bigint")


@query("csv_appended", "SELECT r_regionkey, r_name, count(*) AS n FROM region, range(2) GROUP BY ALL")
def csv_appended(spark, sf_dir):
    """Written twice, the second time added."""
    r, path = table(spark, sf_dir, "region").select("r_regionkey", "r_name"), scratch(spark, "csv")
    for append in (False, True):
        writers.csv(r, path, writers.CsvWriteOptions(append=append, header=True))
    read = files.csv(spark, f"{path}/*.csv", files.CsvOptions(schema=schema("r_regionkey int, r_name string"))).df
    return read.groupBy("r_regionkey", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("file_helpers", "SELECT * FROM (VALUES ('new', 'b'), ('old', 'a'), ('name', 'x/y_1.csv'), ('status', 'MISSING_FILE')) AS v(what, value)")
def file_helpers(spark, sf_dir):
    """Files of the driver: a backup of what is overwritten, names derived from names."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/f.txt"
        for line in ("a", "b"):
            writers.write_in_file([line], path)
        both = [open(path + s).read().strip() for s in ("", ".old")]
        status = support.FilePath(f"{folder}/none").status.name
    return local(spark, [("new", both[0]), ("old", both[1]), ("name", writers.derived_name(os.path.join("x", "y.csv"), lambda s: s + "_1")), ("status", status)], "what string, value string")


# Rows that come from the driver or go there


@query("push_pull", NATIONS)
def push_pull(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return session.push(spark, [tuple(r) for r in session.pull(n)], n.schema, batch_size=7)


@query("terminals", """SELECT (SELECT event_id FROM events WHERE value > 200 ORDER BY event_id LIMIT 1) AS first, -1::BIGINT AS missing, 1::BIGINT AS single, (SELECT count(*) FROM events) AS n,
(SELECT bool_or(value > 200) FROM events) AS any, (SELECT bool_and(value > 200) FROM events) AS every, false AS empty, (SELECT max(event_id) FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 2)) AS second, (SELECT count(*) FROM nation) AS pairs""")
def terminals(spark, sf_dir):
    """Ends of a chain that give values and rows on the driver."""
    e, nation = flow(table(spark, sf_dir, "events"), "event_id"), table(spark, sf_dir, "nation")
    cursor = L.Cursor(L.take(e.df, ["event_id"], 2))
    cursor.try_next()
    none = e.first_or_default(F.col("value") < -1e18)
    row = (
        e.first(F.col("value") > 200)["event_id"], -1 if none is None else none["event_id"], flow(nation.filter("n_nationkey = 1")).single()["n_nationkey"], e.count(), e.any(F.col("value") > 200),
        e.all(F.col("value") > 200), A.is_null_or_empty(e.df), cursor.next_or_default()["event_id"], len(A.to_dictionary(nation, "n_nationkey", "n_name")),
    )
    return local(spark, [row], "first bigint, missing bigint, single bigint, n bigint, any boolean, every boolean, empty boolean, second bigint, pairs bigint")


@query("until_signal", "SELECT n_nationkey FROM nation WHERE n_nationkey <= 4")
def until_signal(spark, sf_dir):
    seen: list = []
    rows = [(r["n_nationkey"],) for r in L.until_signal(table(spark, sf_dir, "nation"), ["n_nationkey"], lambda: seen.append(1) or len(seen) == 5)]
    return local(spark, rows, "n_nationkey int")


@query("to_list", "SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey DESC) - 1 AS place FROM region")
def to_list(spark, sf_dir):
    rows = A.to_list(table(spark, sf_dir, "region").orderBy(F.col("r_regionkey").desc()))
    return local(spark, [(r["r_regionkey"], k) for k, r in enumerate(rows)], "r_regionkey int, place bigint")


@query("sum_float", "SELECT round(sum(value::DOUBLE), 0)::DOUBLE AS total, 0.0::DOUBLE AS of_none FROM events")
def sum_float(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = e.filter("false").agg(A.sum_float(F.col("value")).cast("double").alias("of_none"))
    # Rounded to a place that a 32-bit result has.
    return e.agg(F.sum("value").alias("exact"), A.sum_float(F.col("value")).cast("double").alias("narrow")).select(
        F.when(F.abs(F.col("narrow") - F.col("exact")) <= F.abs(F.col("exact")) * 1e-6, F.round("exact", 0)).alias("total")
    ).crossJoin(F.broadcast(none))


@query("side_effects", "SELECT count(*) AS seen, count(*) AS observed, sum(o_custkey)::BIGINT AS keys, count(*) AS awaited, count(*)::DOUBLE / 2 AS halves FROM orders")
def side_effects(spark, sf_dir):
    """Actions on rows: counted by an accumulator and by an observation, awaited, and passed through lazily."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    seen, awaited, halves = A.long_accumulator(spark), A.long_accumulator(spark), A.double_accumulator(spark)

    async def wait(row):
        awaited.add(1)

    A.do(o, lambda row: halves.add(0.5))
    A.for_each_async(o, wait)
    watched, counts = A.observed(A.for_each(o, lambda batch: seen.add(len(batch))), n=F.count(F.lit(1)), keys=F.sum("o_custkey"))
    A.do(watched)
    return local(spark, [(seen.value, counts.get["n"], counts.get["keys"], awaited.value, halves.value)], "seen bigint, observed bigint, keys bigint, awaited bigint, halves double")


@query("inspected", "SELECT 6::BIGINT AS spied, 4::BIGINT AS shown, true AS passed, true AS planned, true AS described FROM region LIMIT 1")
def inspected(spark, sf_dir):
    """Looking at a frame doesn't change it."""
    r, spied, shown = table(spark, sf_dir, "region"), [], []
    same = V.spy(r, "regions", show=lambda row: row["r_name"], out=spied.append) is r and V.log_spy(r, "regions", 2) is r
    V.display(r, n=3, out=shown.append)
    return local(spark, [(len(spied), len(shown), same, "Scan" in V.explain(r), "r_name" in V.schema_text(r))], "spied bigint, shown bigint, passed boolean, planned boolean, described boolean")


# Cases


@query("select_case_second_indexed", f"SELECT o_orderkey, CASE {BAND} WHEN 0 THEN o_custkey * 2 + p WHEN 1 THEN o_custkey - p END AS new_item FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)")
def select_case_second_indexed(spark, sf_dir):
    first = C.select_case(bands(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")), F.col("o_custkey").cast("long") * 2, F.col("o_custkey").cast("long"))
    return C.select_case_indexed(first, ["o_orderkey"], lambda x, p: x + p, lambda x, p: x - p).select("o_orderkey", "new_item")


@query("cases_each_result", f"SELECT o_orderkey, {BAND} AS sink FROM orders WHERE {BAND} < 2")
def cases_each_result(spark, sf_dir):
    """The typed form: each action sees the rows whose own result is filled."""
    routed, folder = C.select_cases(bands(table(spark, sf_dir, "orders")), F.col("o_orderkey"), F.col("o_orderstatus")), scratch(spark, "each")
    put = lambda k: lambda rows: rows.select("o_orderkey", F.lit(k).alias("sink")).write.parquet(f"{folder}/sink={k}")
    C.for_each_cases(routed, put(0), put(1))
    return spark.read.schema("o_orderkey bigint, sink int").parquet(f"{folder}/sink=0", f"{folder}/sink=1")


@query("cases_note_each", "SELECT 'above 200000' AS label, count(*) AS n FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'below 200000', count(*) FROM orders WHERE NOT o_totalprice > 200000")
def cases_note_each(spark, sf_dir):
    """Actions that get the note; the frame and the note taken apart again."""
    noted = C.with_note(table(spark, sf_dir, "orders"), {"limit": 200000})
    found: list = []
    add = lambda word: lambda rows, n: found.append((f"{word} {n['limit']}", rows.count()))
    df, note = noted.cases(lambda n: F.col("o_totalprice") > n["limit"]).for_each_case(add("above"), add("below"))
    closed: list = []
    noted.without_note(closed.append)
    return local(spark, [r for r in found if closed == [note] and "category" in df.columns], "label string, n bigint")


URL = K.Tokenizer(r"^(?P<scheme>https?)://(?P<host>[^/]+)(?P<path>/[^?#]*)?")


@query("cases_by_group", "SELECT page_id, upper(regexp_extract(url, '^(https?)://', 1)) AS scheme, '<' || regexp_extract(url, '^https?://([^/]+)', 1) || '>' AS host FROM pages")
def cases_by_group(spark, sf_dir):
    tokens = table(spark, sf_dir, "pages").select("page_id", URL.tokenize(F.col("url")).alias("t"))
    same = lambda x: x
    done = tokens.select("page_id", K.select_case_by_group(F.col("t"), {"scheme": F.upper, "host": lambda x: F.concat(F.lit("<"), x, F.lit(">")), "path": same, K.UNMATCHED_SLICE: same, K.UNMATCHED_LINE: same}).alias("t"))
    part = lambda name: F.filter("t", lambda x: x["group_name"] == name)[0]["subpart"].alias(name)
    return done.select("page_id", part("scheme"), part("host"))


@query("cases_each_group", "SELECT 'scheme' AS name, count(*) AS n FROM pages UNION ALL SELECT 'host', count(*) FROM pages")
def cases_each_group(spark, sf_dir):
    found: list = []
    add = lambda name: lambda rows: found.append((name, rows.count()))
    K.for_each_case_by_group(K.tokens_flat(table(spark, sf_dir, "pages"), URL, "url", ["page_id"]), {"scheme": add("scheme"), "host": add("host")})
    return local(spark, found, "name string, n bigint")


# Sets, settings and streams


@query("unify_continues", "SELECT n_nationkey, 'good' AS _source FROM nation")
def unify_continues(spark, sf_dir):
    """A source that can't be analysed is left out."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    both = S.Unified(S.ErrorMode.CONTINUE).unify(n, "good").unify(n, "bad", F.col("no_such_column") > 1)
    return both.read()


@query("parallel_settings", "SELECT o_orderkey, unnest([o_orderkey, o_custkey]) AS item FROM orders WHERE o_orderkey % 3 <> 0")
def parallel_settings(spark, sf_dir):
    """Every setting, a function over rows whose faults are left out, and several results of a row."""

    def keys(row):
        if row["o_orderkey"] % 3 == 0:
            raise ValueError("left out")
        return {"o_orderkey": row["o_orderkey"], "both": [row["o_orderkey"], row["o_custkey"]]}

    p = as_parallel(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).with_max_concurrency(4).with_buffer_size(100).with_merge_options("not_buffered").with_timeout(600).continue_on_error()
    return p.map_rows(keys, "o_orderkey bigint, both array<bigint>").plan().select("o_orderkey", F.explode("both").alias("item"))


@query("parallel_take", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 7")
def parallel_take(spark, sf_dir):
    """Collected under a timeout, in one task."""
    n = table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey")
    rows = as_parallel(n).sequential().with_timeout(600).take(7).collect()
    with cancellable(n, 600):
        return local(spark, [tuple(r) for r in rows], "n_nationkey int")


@query("parallel_select_many", "SELECT unnest(string_split(n_name, 'A')) AS item FROM nation")
def parallel_select_many(spark, sf_dir):
    return as_parallel(table(spark, sf_dir, "nation")).select_many(F.split("n_name", "A", -1)).plan()


def event_stream(spark, sf_dir):
    return streams.read_files(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema, files_per_trigger=1)


@query("stream_bounded", "SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def stream_bounded(spark, sf_dir):
    """A micro-batch held to a hundred rows; of more, the newest go."""
    path = scratch(spark, "bounded")
    sink = lambda rows, _: streams.bounded(rows.select("event_id"), 100, ["event_id"], "drop_newest").write.mode("append").parquet(path)
    q = streams.throttled(event_stream(spark, sf_dir), sink, "100 milliseconds")
    q.processAllAvailable()
    q.stop()
    return L.take(spark.read.schema("event_id bigint").parquet(path), ["event_id"], 100)


@query("stream_until", "SELECT unnest(range(0, 6)) AS n")
def stream_until(spark, sf_dir):
    """A polled source that stops itself by what it has read."""
    source = streams.poll_source(spark, name_of("ticks"), lambda n: [(n + k,) for k in range(3)] if n < 6 else [], "n bigint")
    path = scratch(spark, "until")
    q = streams.stop_when(source, lambda rows: not rows.filter("n >= 5").isEmpty(), lambda rows: rows.write.mode("append").parquet(path), "100 milliseconds", scratch(spark, "offsets"))
    q.awaitTermination(60)
    return spark.read.schema("n bigint").parquet(path)


# Strings, patterns, values


@query("sub_parts", """SELECT doc_id, text = 'a' AS is_a, text IS NULL OR text = '' AS none, text IS NULL OR NOT regexp_matches(text, '[^ \t\r\n]') AS blank, substr(text, 4, greatest(length(text) - 5, 0)) AS inner_,
substr(text, 3) AS tail, substr(text, 1, greatest(length(text) - 2, 0)) AS head, text IS NOT DISTINCT FROM lang AS same FROM documents""")
def sub_parts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("text") == "a").alias("is_a"), X.is_null_or_empty("text").alias("none"), X.is_null_or_white_space("text").alias("blank"), X.trim_part("text", 3, 2).alias("inner_"),
        X.trim_start("text", 2).alias("tail"), X.trim_end("text", 2).alias("head"), X.equals("text", F.col("lang")).alias("same"),
    )


@query("pattern_builders", r"""SELECT page_id, regexp_extract(url, '(https?)', 1) AS scheme, regexp_extract(url, '://([a-z0-9.-]+)', 1) AS host, regexp_matches(url, '\.(com|org|net)') AS top, regexp_matches(url, '(ab)*\d{2,4}') AS digits, regexp_matches(url, '\s+x\s+') AS spaced FROM pages""")
def pattern_builders(spark, sf_dir):
    """Patterns put together from parts, matched in the JVM."""
    scheme, host = K.as_("http" + K.maybe("s")), "://" + K.as_(K.many("[a-z0-9.-]"))
    top, digits = r"\." + K.as_(K.one_of("com", "org", "net")), K.any_of("ab") + K.many(K.NUM, 2, 4)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", scheme, 1).alias("scheme"), F.regexp_extract("url", host, 1).alias("host"), F.col("url").rlike(top).alias("top"), F.col("url").rlike(digits).alias("digits"),
        F.col("url").rlike(K.in_spaces("x")).alias("spaced"),
    )


@query("pattern_words", r"SELECT doc_id, regexp_matches(text, '\s*\w+\s*\s*\w+\s*\s*\w+\s*') AS three FROM documents WHERE regexp_full_match(text, '[ -~\n]*')")
def pattern_words(spark, sf_dir):
    """Three words in a row, in texts of ASCII, where engines agree on what a word is."""
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"^[ -~\n]*\z")).select("doc_id", F.col("text").rlike(K.words(3)).alias("three"))


@query("parsed_values", """SELECT o_orderkey, true AS some_type, o_totalprice AS strict, round(o_totalprice, 1) AS smart, o_custkey::INT AS whole, false AS of_words FROM orders""")
def parsed_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text, plain = F.col("o_totalprice").cast("string"), I.ParseOptions(boolean=False, smart_decimal=False, double=True)
    return o.select(
        "o_orderkey", I.try_infer(text).alias("some_type"), I.parse_as(text, "double").alias("strict"), F.round(F.coalesce(I.smart_double(F.format_string("%.2f", "o_totalprice")), F.col("o_totalprice")), 1).alias("smart"),
        I.parse(F.col("o_custkey").cast("string"), plain)["int"].alias("whole"), I.try_infer(F.concat(F.lit("no. "), "o_orderpriority")).alias("of_words"),
    )


@query("map_values", "SELECT event_id, event_type AS kind, event_id * 2 AS twice, NULL::BIGINT AS missing, false AS added FROM events")
def map_values(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("event_id", "event_type", F.create_map(F.lit("a"), F.col("event_id")).alias("m"))
    set_ = m.withColumn("m2", N.add_or_update("m", "a", F.col("event_id") * 2))
    return set_.select("event_id", F.col("event_type").alias("kind"), N.get_or_null("m2", "a").alias("twice"), N.get_or_null("m2", "b").alias("missing"), N.was_added("m", "a").alias("added"))


# Binding


@query("bind_ordered", "SELECT n_nationkey::BIGINT AS id, n_name AS label, n_regionkey::INT AS region FROM nation")
def bind_ordered(spark, sf_dir):
    """By position, in the order that the fields' metadata gives."""
    f = lambda name, kind, place: T.StructField(name, kind, True, {B.ORDER: place})
    wanted = T.StructType([f("label", T.StringType(), 1), f("id", T.LongType(), 0), f("region", T.IntegerType(), 2)])
    raw = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("x"), F.col("n_name").alias("y"), F.col("n_regionkey").cast("string").alias("z"))
    return B.bind_ordered(raw, wanted)


@query("bind_feed", "SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey + 1 AS n_regionkey FROM nation")
def bind_feed(spark, sf_dir):
    """Some fields fed by names that are only nearly theirs."""
    return B.feed(table(spark, sf_dir, "nation"), {"N_NAME": F.upper("n_name"), "n regionkey": F.col("n_regionkey") + 1})


@query("bind_defaults", "SELECT n_nationkey::BIGINT AS id, n_name AS label, 0::BIGINT AS count_, '' AS note, false AS flag, NULL::DOUBLE AS share FROM nation")
def bind_defaults(spark, sf_dir):
    """A mapping of columns to fields; fields without a column take their default."""
    wanted = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("count_", T.LongType(), False), T.StructField("note", T.StringType(), False),
        T.StructField("flag", T.BooleanType(), False), T.StructField("share", T.DoubleType()),
    ])
    return B.bind(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), wanted, {"n_nationkey": "id", "n_name": "label"})


# Tables


@query("table_written", "SELECT r_regionkey, r_name, count(*) AS n FROM region, range(2) GROUP BY ALL")
def table_written(spark, sf_dir):
    """A table made, added to and read through the chain."""
    name, r = name_of("regions"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    for _ in range(2):
        flow(r).write_table(name)
    out = settled(flow(r).table(spark, name).df.groupBy("r_regionkey", "r_name").agg(F.count(F.lit(1)).alias("n")), "regions")
    spark.sql(f"DROP TABLE {name}")
    return out


@query("table_merged", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT max(c_custkey) + 1, 'added' FROM customer")
def table_merged(spark, sf_dir):
    """Updates and a row that is new, merged into a table by key."""
    name, c = name_of("customers"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    M.write_table(c, name)
    new = c.agg((F.max("c_custkey") + 1).alias("c_custkey")).withColumn("c_name", F.lit("added"))
    M.merge_table(spark, name, c.filter("c_custkey % 10 = 0").withColumn("c_name", F.lit("new")).unionByName(new), "c_custkey")
    out = settled(spark.table(name), "customers")
    spark.sql(f"DROP TABLE {name}")
    return out


@query("tables_by_case", f"SELECT o_orderkey, {BAND} AS kind FROM orders WHERE {BAND} < 2")
def tables_by_case(spark, sf_dir):
    """Each category written to, then merged into, a table of its own."""
    names, routed = [name_of("high"), name_of("middle")], bands(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    C.write_tables(routed, *names)
    C.merge_tables(routed, *[(n, "o_orderkey") for n in names])
    both = [spark.table(n).select("o_orderkey", F.lit(k).alias("kind")) for k, n in enumerate(names)]
    out = settled(both[0].unionByName(both[1]), "kinds")
    for n in names:
        spark.sql(f"DROP TABLE {n}")
    return out


@query("cache_repartition", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def cache_repartition(spark, sf_dir):
    kept = flow(table(spark, sf_dir, "orders")).repartition(4, "o_custkey").cache()
    out = settled(kept.group_by(["o_custkey"], F.count(F.lit(1)).alias("n")).df, "counts")
    kept.df.unpersist()
    return out


@query("partitioned_files", "SELECT o_orderkey, o_orderstatus FROM orders")
def partitioned_files(spark, sf_dir):
    path = scratch(spark, "parted")
    flow(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")).write_parquet(path, ["o_orderstatus"])
    return spark.read.schema("o_orderkey bigint, o_orderstatus string").parquet(path)


@query("support_helpers", """SELECT * FROM (VALUES ('watched', '5'), ('arguments', 'in.csv 3'), ('configured', 'in.csv 7'), ('guard', 'x is null'), ('grammar', 'DIGESTED COMPLETED NONE'), ('logged', '3')) AS v(what, value)""")
def support_helpers(spark, sf_dir):
    """The helpers around queries, each used once."""
    import dataclasses
    import io

    seen: list = []
    w = support.Watched(1) + seen.append
    w.value = 5
    args = support.check_arguments([support.Requirement("path", mandatory=True), support.Requirement("n", default="3")], ["--path", "in.csv"])

    @dataclasses.dataclass
    class Config:
        path: str
        n: int = 7

    config = support.configure(Config, ["--path", "in.csv"])
    try:
        support.Guard.not_null(None, "x")
    except ValueError as e:
        guard = str(e)
    matcher = support.TokenMatcher(support.Sequence_(support.Terminal("a"), support.OneOf(support.Terminal("b"), support.Terminal("c"))))
    steps = [matcher.accept(x) for x in ("a", "c", "d")]
    words = ["COMPLETED" if support.Digestion.COMPLETED in s else "DIGESTED" if support.Digestion.DIGESTED in s else "NONE" for s in steps]
    logged = support.Logged(1, support.logger(name_of("log"), stream=io.StringIO())) + 2
    rows = [("watched", str(seen[0])), ("arguments", f"{args['path']} {args['n']}"), ("configured", f"{config.path} {config.n}"), ("guard", guard), ("grammar", " ".join(words)), ("logged", str(logged.value))]
    return local(spark, rows, "what string, value string")
