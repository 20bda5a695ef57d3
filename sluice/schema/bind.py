"""Rows of text or loose types as rows of a schema: one projection of casts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.parsing import boolean_of, decimal_of, double_of, timestamp_of
from sluice.schema.resolve import resolve

#: StructField metadata: the place of a field in positional binding, allowed values, and dates' formats.
ORDER, ALLOWED, FORMATS = "order", "allowed", "formats"
DEFAULTS = {"boolean": False, "string": ""}


#: Numbers that every reading takes alike.
PLAIN = r"^[+-]?[0-9]+([.][0-9]*)?$"


def seldom(text: Column, f: Callable[[Column], Column]) -> Column:
    """f(text) out of line: long expressions that few rows need would make the code of all rows too long to be compiled."""
    return F.get(F.transform(F.array(text), f), F.lit(0))


def converted(value: Column, source: T.DataType, field: T.StructField) -> Column:
    """A column as the field's type. Text that isn't one becomes null; empty text is null, or the default of a field that can't be."""
    to = field.dataType
    if not isinstance(source, T.StringType) or isinstance(to, T.StringType) and ALLOWED not in (field.metadata or {}):
        return value if source == to else value.try_cast(to)
    text = F.btrim(value, F.lit(" \t\r\n"))
    kind = to.simpleString()
    if isinstance(to, T.BooleanType):
        out = F.coalesce(boolean_of(text), F.when(text == "1", True).when(text == "0", False))
    elif isinstance(to, T.DecimalType):
        out = F.when(text.rlike(PLAIN), text.try_cast(kind)).otherwise(seldom(text, lambda t: decimal_of(t, kind)))
    elif isinstance(to, (T.FloatType, T.DoubleType)):
        out = F.coalesce(text.try_cast(kind), seldom(text, lambda t: double_of(t).try_cast(kind)))
    elif isinstance(to, T.TimestampType):
        tries = [F.try_to_timestamp(text, F.lit(f)) for f in (field.metadata or {}).get(FORMATS, ())]
        out = F.coalesce(*tries, timestamp_of(text))
    elif isinstance(to, (T.ArrayType, T.MapType, T.StructType)):
        out = F.from_json(text, to)
    elif isinstance(to, T.StringType):
        allowed = field.metadata[ALLOWED]
        out = F.when(text.isin(allowed), text)
        for a in allowed:
            out = F.when(F.lower(text) == a.lower(), a).otherwise(out)
    elif isinstance(to, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = F.when(text.rlike(r"^[+-]?[0-9,]+$"), F.replace(text, F.lit(","))).try_cast(kind)
    else:
        out = text.try_cast(kind)
    return out if field.nullable else F.when(text.isNull() | (text == ""), default(to)).otherwise(out)


def default(to: T.DataType) -> Column:
    if isinstance(to, T.NumericType):
        return F.lit(0).cast(to)
    return F.lit(DEFAULTS.get(to.simpleString())).cast(to)


def bind(df: DataFrame, schema: T.StructType, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """df as the schema. mapping (column -> field) goes before the resolver; fields without a column are null or their default."""
    given = {c: f for c, f in (mapping or {}).items() if c in df.columns}
    rest = resolve([c for c in df.columns if c not in given], [f.name for f in schema if f.name not in given.values()])
    of = {f: c for c, f in (given | rest).items()}
    out = []
    for f in schema:
        if f.name in of:
            c = of[f.name]
            out.append(converted(F.col(f"`{c}`"), df.schema[c].dataType, f).alias(f.name))
        else:
            out.append((F.lit(None).cast(f.dataType) if f.nullable else default(f.dataType)).alias(f.name))
    return df.select(*out)


def ordered_fields(schema: T.StructType) -> list[T.StructField]:
    """By their order metadata, then as declared."""
    return [f for _, f in sorted(enumerate(schema), key=lambda x: ((x[1].metadata or {}).get(ORDER, x[0]), x[0]))]


def bind_ordered(df: DataFrame, schema: T.StructType) -> DataFrame:
    """By position; surplus columns are left out."""
    fields = ordered_fields(schema)
    pairs = list(zip(df.columns, fields, strict=False))
    own = {f.name: converted(F.col(f"`{c}`"), df.schema[c].dataType, f) for c, f in pairs}
    return df.select(*[own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def feed(df: DataFrame, values: Mapping[str, Column], columns: Sequence[str] | None = None) -> DataFrame:
    """A partial update: each name is resolved to a column of df and takes the value; others stay."""
    found = resolve(list(values), list(columns or df.columns))
    return df.withColumns({found[n]: v.cast(df.schema[found[n]].dataType) for n, v in values.items() if n in found})
