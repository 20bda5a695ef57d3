"""Text, CSV, JSON and parsed strings as DataFrames.

Plain text and NDJSON are splittable and stay in the JVM. CSV whose fields may hold
line ends, JSON documents, YAML and workbooks are read a file to a task, in pieces.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.parsing import ParseOptions, infer
from sluice.schema.bind import bind
from sluice.sources.errors import Action, ReadOptions, Result, error, no_error, split
from sluice.sources.rfc4180 import Dialect, QuoteMode, records

#: Fields, faults and places of parsed files.
RAW = "_file string, _record long, _line long, _raw string, _fields array<string>, _kind string, _message string"
CHUNK = 1 << 16


def text(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """value and _file: a row for each line."""
    if encoding.upper().replace("-", "") in ("UTF8", "USASCII"):
        lines = spark.read.text(path)
        return lines.select("value", F.col("_metadata.file_path").alias("_file"))
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_file"), F.decode("content", encoding).alias("t"))
    lines = F.split(F.regexp_replace(F.regexp_replace("t", "^\ufeff", ""), r"\r?\n$", ""), r"\r\n|\n|\r", -1)
    return whole.select(F.explode(lines).alias("value"), "_file")


@dataclass
class CsvOptions(ReadOptions):
    separator: str = ","
    schema: T.StructType | Sequence[str] | None = None
    header: bool = True
    trim: bool = False
    allow_missing: bool = True
    allow_extra: bool = False
    quote_mode: QuoteMode = QuoteMode.STRICT
    trailing_garbage_is_error: bool = False
    normalize_newlines: bool = False
    infer_schema: bool = False
    sample_rows: int = 100
    column_name: Callable[[int], str] = lambda k: f"Column{k + 1}"
    parse: ParseOptions = field(default_factory=ParseOptions)
    max_columns: int | None = None
    max_record_length: int | None = None
    encoding: str = "utf-8"
    multi_line: bool = True
    """Whether fields may hold line ends; a file is one task then. Without, large files are split."""
    numbered: bool = False
    """Whether error rows must have line and record numbers: the exact parser reads all records then, not only odd ones."""
    convert: Callable[[str, Column], Column] | None = None
    """Own conversion of a field: (name, text) -> column."""

    def dialect(self) -> Dialect:
        return Dialect(self.separator, self.quote_mode, self.trailing_garbage_is_error, self.trim, self.normalize_newlines, self.max_columns, self.max_record_length)


def parsed(files: DataFrame, options: CsvOptions) -> DataFrame:
    """files (_file, content) as RAW rows."""
    dialect, encoding = options.dialect(), options.encoding

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_file", "_record", "_line", "_raw", "_fields", "_kind", "_message"]
        for batch in batches:
            for name, content in zip(batch["_file"], batch["content"], strict=True):
                reader = io.TextIOWrapper(io.BytesIO(content), "utf-8-sig" if encoding.lower().replace("-", "") == "utf8" else encoding, newline="")
                rows = []
                for r in records(iter(lambda f=reader: f.read(CHUNK), ""), dialect):
                    rows.append((name, r.number, r.line, r.raw, r.fields, *(r.fault or (None, None))))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, RAW)


def contents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("_file"), "content")


def csv(spark: SparkSession, path: str | Sequence[str], options: CsvOptions | None = None) -> Result:
    """Records with the header's, the schema's or made-up names; text columns unless a schema or inference types them.

    Spark's own parser reads the records, and those that it finds odd go to the exact
    one. What needs every record's quotes, length or number looked at is read by the
    exact parser alone: STOP, the other quote modes, limits and numbered errors.
    """
    o = options or CsvOptions()
    exact = o.numbered or o.policy() is Action.STOP or o.quote_mode is not QuoteMode.STRICT or o.trailing_garbage_is_error or o.normalize_newlines
    if exact or o.max_columns is not None or o.max_record_length is not None:
        return csv_of(parsed(contents(spark, path), o), o)
    return csv_native(spark, path, o)


def csv_native(spark: SparkSession, path: str | Sequence[str], o: CsvOptions) -> Result:
    head = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    first = next(iter(records([head[0]["value"].lstrip("\ufeff")], o.dialect())), None) if head else None
    names = named_columns(first.fields if first else None, o)
    if not names:
        return csv_of(parsed(contents(spark, path), o), o)
    kinds = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))] + [T.StructField("_bad", T.StringType())])
    # Without all columns a record's size isn't seen: no pruning.
    lines = (
        spark.read.schema(kinds)
        .options(sep=o.separator[:1] or ",", header=o.header, quote='"', escape='"', multiLine=o.multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", encoding=o.encoding)
        .options(ignoreLeadingWhiteSpace=o.trim, ignoreTrailingWhiteSpace=o.trim, maxCharsPerColumn=-1, enforceSchema=True, columnPruning=False)
        .csv(path)
    )
    dialect = o.dialect()

    @F.pandas_udf("struct<fields:array<string>,kind:string,message:string>")
    def again(raw: pd.Series) -> pd.DataFrame:
        out = []
        for text in raw:
            r = next(records([text], dialect), None) if text is not None else None
            out.append((r.fields if r else None, *((r.fault if r else None) or (None, None))))
        return pd.DataFrame(out, columns=["fields", "kind", "message"])

    number = F.lit(None).cast("long")
    # Spark refuses queries of the odd records' column alone; this one is always true.
    lines = lines.filter("length(coalesce(c0, '')) >= 0").withColumns({"_file": F.col("_metadata.file_path"), "_record": number, "_line": number})
    # Records in order stay in the JVM; only odd ones go to Python. Reading twice is cheaper than sending all through.
    cells = [F.coalesce(F.col(f"c{k}"), F.lit("")).alias(c) for k, c in enumerate(names)]
    fine = lines.filter("_bad IS NULL").select("_file", "_record", "_line", F.col("_bad").alias("_raw"), no_error().alias("_error"), *cells)
    odd = lines.filter("_bad IS NOT NULL").withColumn("_r", again("_bad"))
    fields = F.coalesce("_r.fields", F.array().cast("array<string>"))
    odd = odd.select("_file", "_record", "_line", F.col("_bad").alias("_raw"), fields.alias("_fields"), F.col("_r.kind").alias("_kind"), F.col("_r.message").alias("_message"))
    return csv_result(fine.unionByName(csv_judged(odd, names, o)), names, o)


def named_columns(first: list[str] | None, o: CsvOptions) -> list[str]:
    """The columns' names from the first record and the options."""
    if o.schema is not None and not isinstance(o.schema, T.StructType):
        names = list(o.schema)
    elif o.header:
        names = list(first) if first is not None else [f.name for f in o.schema or T.StructType()]
    elif isinstance(o.schema, T.StructType):
        names = [f.name for f in o.schema]
    else:
        names = [o.column_name(k) for k in range(len(first or ()))]
    if len(set(names)) < len(names):
        raise ValueError("column names come twice")
    return names


def csv_simple(spark: SparkSession, path: str, separator: str = ",", on_error=None, *schema: str) -> DataFrame:
    """Header or the given names; faulty records are skipped if on_error is given, else they fail the read."""
    result = csv(spark, path, CsvOptions(separator=separator, on_error=on_error, schema=list(schema) or None))
    return result.finish().df if on_error else result.df


def csv_text(spark: SparkSession, content: str, options: CsvOptions | None = None) -> Result:
    files = spark.createDataFrame([("text", bytearray(content.encode()))], "_file string, content binary")
    options = replace(options or CsvOptions(), encoding="utf-8")
    return csv_of(parsed(files, options), options)


def csv_of(raw: DataFrame, options: CsvOptions) -> Result:
    first = raw.filter("_record = 1").select("_fields").limit(1).collect()
    names = named_columns(first[0]["_fields"] if first else None, options)
    return csv_result(csv_judged(raw.filter("_record > 1") if options.header else raw, names, options), names, options)


def csv_judged(body: DataFrame, names: list[str], options: CsvOptions) -> DataFrame:
    """RAW rows with their fault, null if fine, and their cells."""
    n = F.size("_fields")
    fault = (
        F.when(F.col("_kind").isNotNull(), F.struct(F.col("_kind").alias("type"), F.col("_message").alias("message")))
        .when((n > len(names)) & F.lit(not options.allow_extra), error("SchemaError", F.concat(n.cast("string"), F.lit(f" fields for {len(names)} columns"))))
        .when((n < len(names)) & F.lit(not options.allow_missing), error("SchemaError", F.concat(n.cast("string"), F.lit(f" fields of {len(names)}"))))
        .otherwise(no_error())
    )
    cells = [F.get("_fields", F.lit(k)).alias(c) for k, c in enumerate(names)]
    return body.select("_file", "_record", "_line", "_raw", fault.alias("_error"), *cells)


def csv_result(rows: DataFrame, names: list[str], options: CsvOptions) -> Result:
    """Judged rows as records and errors, typed by the options."""
    result = split(rows, "Csv", options, [F.col(f"`{c}`") for c in names])
    if options.convert is not None:
        result.df = result.df.select(*[options.convert(c, F.col(f"`{c}`")).alias(c) for c in names])
    elif isinstance(options.schema, T.StructType):
        result.df = bind(result.df, options.schema)
    elif options.infer_schema:
        result.df = bind(result.df, inferred(result.df, options))
    return result


def inferred(df: DataFrame, options: CsvOptions) -> T.StructType:
    """Types of text columns from sample rows: the first of the ladder that fails at most once among them. Later misfits become null."""
    p = replace(options.parse, double=True)
    sample = [(k, v) for r in df.limit(options.sample_rows).collect() for k, v in enumerate(r) if v]
    # One expression over all cells, however many columns there are.
    found = df.sparkSession.createDataFrame(sample, "k int, text string").select("k", "text", infer("text", p)["tag"].alias("tag"))
    cells: dict[int, list[tuple[str, str]]] = {}
    for k, v, tag in found.collect():
        cells.setdefault(k, []).append((v, tag))
    accepts = {
        "boolean": {"boolean"}, "int": {"int"}, "long": {"int", "long"}, "decimal": {"int", "long", "decimal"}, "double": {"int", "long", "decimal", "double"},
        "timestamp": {"timestamp"}, "guid": {"guid"},
    }
    kinds = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "decimal": T.DecimalType(38, 10), "double": T.DoubleType(), "timestamp": T.TimestampType(), "guid": T.StringType()}
    out = T.StructType()
    for k, c in enumerate(df.columns):
        tags = [tag for _, tag in cells.get(k, ())]
        # Digits that must stay as written rule numbers out at once.
        kept = any(tag == "string" and v.strip().isdigit() for v, tag in cells.get(k, ()))
        kind: T.DataType = T.StringType()
        for name, ok in accepts.items():
            if tags and sum(t not in ok for t in tags) <= 1 and any(t in ok for t in tags) and not (kept and name not in ("boolean", "timestamp", "guid")):
                kind = kinds[name]
                break
        out.add(c, kind)
    return out


@dataclass
class JsonOptions(ReadOptions):
    schema: T.StructType | None = None
    validator: Column | None = None
    """A condition on the bound columns; rows that fail it are JsonValidationFailed."""
    max_elements: int | None = None
    max_element_bytes: int | None = None
    max_string_length: int | None = None
    single_root: bool = True
    """Whether a root that is no array is one record."""


#: White space and comments, whole ones or one that the text's end cuts.
GAP = re.compile(r"(?:[ \t\r\n]++|//[^\n]*+|/\*.*?(?:\*/|\Z))*+", re.DOTALL)
#: A string, a comment, a comma before a closing bracket, or one other character.
LOOSE = re.compile(rf'(?P<text>"(?:[^"\\]|\\.)*+"?+)|(?P<comment>//[^\n]*+|/\*.*?(?:\*/|\Z))|(?P<comma>,(?={GAP.pattern}[}}\]]))', re.DOTALL)


def elements(content: bytes) -> Iterator[tuple[object, str, tuple[str, str] | None, bool]]:
    """(value, text, fault, plain) of the root array's elements in turn, or of the root. Comments and trailing commas are let by; plain texts have none."""
    src = content.decode("utf-8-sig")
    decoder = json.JSONDecoder()

    def gap(i: int) -> int:
        return GAP.match(src, i).end()

    def value(i: int) -> tuple[object, int, bool]:
        try:
            return *decoder.raw_decode(src, i), True
        except json.JSONDecodeError:
            end = matching(src, i)
            return json.loads(relaxed(src[i:end])), end, False

    i = gap(0)
    if i >= len(src):
        yield None, "", ("JsonRootError", "no value"), False
        return
    if src[i] != "[":
        try:
            v, end, plain = value(i)
            yield v, src[i:end], None, plain
        except ValueError as e:
            yield None, src[i : i + 200], ("JsonException", str(e)), False
        return
    i = gap(i + 1)
    while i < len(src) and src[i] != "]":
        try:
            v, end, plain = value(i)
        except ValueError as e:
            end = matching(src, i)
            yield None, src[i:end], ("JsonException", str(e)), False
        else:
            yield v, src[i:end], None, plain
        i = gap(end)
        if i < len(src) and src[i] == ",":
            i = gap(i + 1)
        elif i < len(src) and src[i] != "]":
            yield None, src[i : i + 200], ("JsonException", "a comma or the end of the array was due"), False
            return
    if i >= len(src):
        yield None, src[-200:], ("JsonException", "the array never ends"), False


def matching(src: str, i: int) -> int:
    """Where the value at i ends by its brackets, or at the next comma or bracket."""
    depth, quoted, k = 0, False, i
    while k < len(src):
        c = src[k]
        if quoted:
            if c == "\\":
                k += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            if depth == 0:
                return k
            depth -= 1
            if depth == 0:
                return k + 1
        elif c == "," and depth == 0:
            return k
        k += 1
    return len(src)


def relaxed(src: str) -> str:
    """Without comments and trailing commas; strings stay as they are."""
    return LOOSE.sub(lambda m: m["text"] or "", src)


def longest_string(v: object) -> int:
    if isinstance(v, str):
        return len(v)
    if isinstance(v, dict):
        return max(map(longest_string, v.values()), default=0)
    return max(map(longest_string, v), default=0) if isinstance(v, list) else 0


def renamer(to: T.DataType | None) -> Callable[[object], object] | None:
    """Gives property names as the schema writes them; they match in any case, exact ones first. None if the type has no names.

    A flat object whose names are right comes back itself.
    """
    if isinstance(to, T.ArrayType):
        one = renamer(to.elementType)
        return None if one is None else lambda v: [one(x) for x in v] if isinstance(v, list) else v
    if not isinstance(to, T.StructType):
        return None
    inner = {f.name: renamer(f.dataType) for f in to}
    lower = {f.name.lower(): f.name for f in to}
    flat = not any(inner.values())

    def run(v: object) -> object:
        if not isinstance(v, dict) or (flat and v.keys() <= inner.keys()):
            return v
        out = {}
        for k, x in v.items():
            name = k if k in inner else lower.get(k.lower())
            if name is None:
                out[k] = x
            elif name == k or name not in v:
                out[name] = inner[name](x) if inner[name] else x
        return out

    return run


def json_rows(files: DataFrame, options: JsonOptions, field: str = "content") -> DataFrame:
    o, schema = (options.max_elements, options.max_element_bytes, options.max_string_length, options.single_root), options.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most, size, length, single = o
        names = ["_file", "_record", "_line", "_raw", "_value", "_kind", "_message"]
        rename = renamer(schema) or (lambda v: v)
        for batch in batches:
            for name, content in zip(batch["_file"], batch[field], strict=True):
                rows = []
                data = content if isinstance(content, bytes) else str(content).encode()
                array = data.decode("utf-8-sig").lstrip()[:1] == "["
                for k, (v, src, fault, plain) in enumerate(elements(data), 1):
                    if fault is None and not array and not single:
                        fault = ("JsonRootError", "the root is no array")
                    if most is not None and k > most:
                        rows.append((name, k, None, src[:200], None, "JsonSizeLimit", f"more than {most} elements"))
                        break
                    if fault is None and v is None:
                        continue  # null elements are no records
                    if fault is None and size is not None and len(src.encode()) > size:
                        fault = ("JsonSizeLimit", f"longer than {size} bytes")
                    if fault is None and length is not None and longest_string(v) > length:
                        fault = ("JsonSizeLimit", f"a string longer than {length}")
                    # A text that is JSON with the schema's names goes on as it is.
                    renamed = None if fault else rename(v)
                    text = None if fault else src if plain and renamed == v else json.dumps(renamed, ensure_ascii=False)
                    rows.append((name, k, None, src, text, *(fault or (None, None))))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, "_file string, _record long, _line long, _raw string, _value string, _kind string, _message string")


def json_documents(spark: SparkSession, path: str | Sequence[str], options: JsonOptions) -> Result:
    """Elements of root arrays, or single roots, bound to the schema by policy."""
    return json_of(json_rows(contents(spark, path), options), options)


def json_text(spark: SparkSession, content: str, options: JsonOptions) -> Result:
    files = spark.createDataFrame([("text", bytearray(content.encode()))], "_file string, content binary")
    return json_of(json_rows(files, options), options)


def json_of(raw: DataFrame, options: JsonOptions, reader: str = "Json") -> Result:
    schema = options.schema
    if schema is None:
        # All values are read, so a property that comes late is in the schema too.
        values = raw.filter("_value IS NOT NULL").select("_value")
        schema = raw.sparkSession.read.json(values.rdd.map(lambda r: r[0])).schema
    # Property names match in any case; the text that can't be bound is a fault.
    bound = F.from_json("_value", T.StructType([*schema, T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = raw.withColumn("_v", bound)
    fault = F.when(F.col("_kind").isNotNull(), F.struct(F.col("_kind").alias("type"), F.col("_message").alias("message"))).when(
        F.col("_v").isNull() | F.col("_v._corrupt_record").isNotNull(), error("JsonException", "the value doesn't fit the schema")
    )
    names = [f.name for f in schema]
    rows = rows.select("_file", "_record", "_line", "_raw", fault.otherwise(no_error()).alias("_error"), *[F.col(f"_v.`{c}`").alias(c) for c in names])
    if options.validator is not None:
        failed = F.col("_error").isNull() & ~F.coalesce(options.validator, F.lit(False))
        rows = rows.withColumn("_error", F.when(failed, error("JsonValidationFailed", "the validator refused it")).otherwise(F.col("_error")))
    return split(rows, reader, options, [F.col(f"`{c}`") for c in names])


def ndjson(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, action: Action = Action.THROW) -> DataFrame:
    """JSON lines: Spark's own splittable reader. STOP needs json_documents."""
    mode = {Action.THROW: "FAILFAST", Action.SKIP: "DROPMALFORMED"}[action]
    return spark.read.schema(schema).option("mode", mode).json(path)


def json_column(text_: str | Column, schema: T.DataType) -> Column:
    """A column of JSON arrays as arrays of the schema, to explode."""
    return F.from_json(text_, T.ArrayType(schema))


def csv_column(text_: str | Column, ddl: str, separator: str = ",") -> Column:
    return F.from_csv(text_, ddl, {"sep": separator})
