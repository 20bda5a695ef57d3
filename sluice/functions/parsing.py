"""Types from text: strict casts, decimals of any locale, and the inference ladder, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.text import col, is_all_digits

GUID = r"^[{(]?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}[)}]?$"
DECIMAL = "decimal(38,10)"


@dataclass(frozen=True)
class ParseOptions:
    """What the ladder tries. custom_first and custom_last map the text to (handled, tag) columns."""

    trim: bool = True
    keep_leading_zeros: bool = True
    keep_large_integers: bool = True
    large_integer_digits: int = 19
    boolean: bool = True
    int32: bool = True
    int64: bool = True
    decimal: bool = True
    double: bool = False
    timestamp: bool = True
    guid: bool = True
    smart_decimal: bool = True
    custom_first: Callable[[Column], tuple[Column, Column]] | None = None
    custom_last: Callable[[Column], tuple[Column, Column]] | None = None


def normalize_decimal(text) -> Column:
    """The text with a dot as its only mark, or null where there is none or its meaning is open.

    Of dots and commas, the last one is the decimal mark; a mark that comes twice
    separates thousands; a single mark before exactly three digits could be either.
    Blanks and no-break spaces inside go.
    """
    t = F.btrim(col(text), F.lit(" \t\r\n\u00a0"))
    sign = F.when(t.rlike("^[+-]"), F.substring(t, 1, 1)).otherwise("")
    body = F.translate(F.when(t.rlike("^[+-]"), F.substring(t, 2, 2**31 - 1)).otherwise(t), " \u00a0", "")
    dots = F.length(body) - F.length(F.replace(body, F.lit(".")))
    commas = F.length(body) - F.length(F.replace(body, F.lit(",")))
    last_dot, last_comma = F.length(body) - F.instr(F.reverse(body), "."), F.length(body) - F.instr(F.reverse(body), ",")
    no_dots, no_commas = F.replace(body, F.lit(".")), F.replace(body, F.lit(","))
    value = (
        F.when(~body.rlike(r"^[0-9.,]+$") | ((dots == 0) & (commas == 0)), None)
        .when((dots > 0) & (commas > 0), F.when(last_comma > last_dot, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when(dots > 1, no_dots)
        .when(commas > 1, no_commas)
        .when((dots == 1) & ~body.rlike(r"\.[0-9]{3}$"), body)
        .when((commas == 1) & ~body.rlike(r",[0-9]{3}$"), F.replace(body, F.lit(","), F.lit(".")))
    )
    return F.concat(sign, value)


def smart_decimal(text, kind: str = DECIMAL) -> Column:
    """The decimal of a text whose marks leave no doubt; null without marks, and where they do."""
    return normalize_decimal(text).try_cast(kind)


def smart_double(text) -> Column:
    return normalize_decimal(text).try_cast("double")


def decimal_of(text, kind: str = DECIMAL) -> Column:
    """smart_decimal, else a plain number in which a dot is the mark and commas separate thousands."""
    return F.coalesce(smart_decimal(text, kind), plain_number(text).try_cast(kind))


def double_of(text) -> Column:
    return F.coalesce(smart_double(text), plain_number(text).try_cast("double"))


def plain_number(text) -> Column:
    """Digits with an optional sign and thousands commas, without a decimal mark that could be read in two ways."""
    t = F.btrim(col(text), F.lit(" \t\r\n"))
    return F.when(t.rlike(r"^[+-]?[0-9][0-9,]*(\.[0-9]*)?$"), F.replace(t, F.lit(",")))


def boolean_of(text) -> Column:
    """true or false in any case."""
    t = F.lower(F.btrim(col(text), F.lit(" \t\r\n")))
    return F.when(t == "true", True).when(t == "false", False)


def timestamp_of(text) -> Column:
    """ISO dates and times, and month-first dates with slashes; in the session's zone unless the text names another."""
    t = F.btrim(col(text), F.lit(" \t\r\n"))
    iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T].*)?$"), t.try_cast("timestamp"))
    slashed = F.when(t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_timestamp(t, F.lit("M/d/yyyy")))
    return F.coalesce(iso, slashed)


def infer(text, options: ParseOptions | None = None) -> Column:
    """struct<tag, bool, int, long, decimal, double, timestamp, guid, string>: the first type of the ladder that the text has.

    tag names it: boolean, int, long, decimal, double, timestamp, guid or string; null
    and empty texts are strings. Digits with a leading zero, and of 19 and more
    places, stay text.
    """
    o = options or ParseOptions()
    raw = col(text)
    t = F.btrim(raw, F.lit(" \t\r\n")) if o.trim else raw
    digits = is_all_digits(t)
    kept = F.lit(False)
    if o.keep_leading_zeros:
        kept = kept | (digits & t.startswith("0") & (F.length(t) > 1))
    if o.keep_large_integers:
        kept = kept | (digits & (F.length(t) >= o.large_integer_digits))
    whole = F.when(t.rlike(r"^[+-]?[0-9]+$"), t)
    as_int, as_long = whole.try_cast("int"), whole.try_cast("long")
    as_decimal = decimal_of(t) if o.smart_decimal else plain_number(t).try_cast(DECIMAL)
    as_double = F.coalesce(double_of(t), F.when(t.rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"), t.try_cast("double")))
    guid = F.when(t.rlike(GUID), F.lower(F.regexp_replace(t, "[^0-9a-fA-F]", "")))
    guid = F.regexp_replace(guid, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    values = {"boolean": boolean_of(t), "int": as_int, "long": as_long, "decimal": as_decimal, "double": as_double, "timestamp": timestamp_of(t), "guid": guid}
    on = {"boolean": o.boolean, "int": o.int32, "long": o.int64, "decimal": o.decimal, "double": o.double, "timestamp": o.timestamp, "guid": o.guid}
    tag = F.lit("string")
    if o.custom_last:
        handled, own = o.custom_last(t)
        tag = F.when(handled, own).otherwise(tag)
    for name in reversed([n for n in values if on[n]]):
        tag = F.when(values[name].isNotNull(), name).otherwise(tag)
    tag = F.when(kept | t.isNull(), "string").otherwise(tag)
    if o.custom_first:
        handled, own = o.custom_first(t)
        tag = F.when(handled, own).otherwise(tag)
    return F.struct(tag.alias("tag"), *[F.when(tag == n, v).alias(n) for n, v in values.items()], t.alias("string"))


def try_infer(text, options: ParseOptions | None = None) -> Column:
    """Whether the text is anything but a string."""
    return infer(text, options)["tag"] != "string"


def parse(text, options: ParseOptions | None = None) -> Column:
    return infer(text, options)


def parse_as(text, kind: str) -> Column:
    """Strict: raises on text that isn't of the type."""
    return F.btrim(col(text), F.lit(" \t\r\n")).cast(kind)


def try_parse(text, kind: str) -> Column:
    return F.btrim(col(text), F.lit(" \t\r\n")).try_cast(kind)
