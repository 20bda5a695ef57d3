"""String helpers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_between(text, start: str | None, end: str | None) -> Column:
    """Starts with start and ends with end; false if anything is null."""
    t = col(text)
    return F.coalesce(t.startswith(F.lit(start)) & t.endswith(F.lit(end)), F.lit(False))


def starts_with_any(text, prefixes: Sequence[str]) -> Column:
    tests = [col(text).startswith(p) for p in prefixes]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def contains_any(text, tokens: Sequence[str]) -> Column:
    """The first token that matches decides; an empty token always matches, and then the answer is false."""
    before = list(tokens[: tokens.index("")]) if "" in tokens else list(tokens)
    tests = [col(text).contains(t) for t in before]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def is_null_or_empty(text) -> Column:
    return col(text).isNull() | (col(text) == "")


def is_null_or_white_space(text) -> Column:
    return col(text).isNull() | col(text).rlike(r"^[\s\u0085\p{Z}]*$")


def last_idx(text) -> Column:
    """Length less 1; an empty text raises."""
    t = col(text)
    return F.when(t == "", F.raise_error(F.lit("an empty text has no last index")).cast("int")).otherwise(F.length(t) - 1)


def last_idx_of(array) -> Column:
    """Size less 1: -1 for an empty collection."""
    return F.size(col(array)) - 1


def replace_at(text, index: int, length: int, insert: str) -> Column:
    """Keeps the characters up to and including index, then insert, then what follows index + length."""
    t = col(text)
    return F.concat(F.substring(t, 1, index + 1), F.lit(insert), F.substring(t, index + length + 1, 2**31 - 1))


def overlay_at(text, index: int, length: int, insert: str) -> Column:
    """Replaces exactly the length characters from index on."""
    return F.overlay(col(text), F.lit(insert), F.lit(index + 1), F.lit(length))


def sub_part(text, start, end) -> Column:
    """Characters from start up to end (exclusive); null unless 0 <= start <= end <= length - 1."""
    t, s, e = col(text), F.lit(start), F.lit(end)
    return F.when((s >= 0) & (s <= e) & (e <= F.length(t) - 1), F.substring(t, s + 1, e - s))


def trim_part(text, start: int, end: int) -> Column:
    """Moves both bounds inwards, as far as there are characters."""
    t = col(text)
    n = F.length(t)
    a = F.least(F.lit(start), n)
    return F.substring(t, a + 1, F.greatest(n - a - end, F.lit(0)))


def trim_start(text, steps: int) -> Column:
    return trim_part(text, steps, 0)


def trim_end(text, steps: int) -> Column:
    return trim_part(text, 0, steps)


def equals(a, b) -> Column:
    """Equal, two nulls included."""
    return col(a).eqNullSafe(b if isinstance(b, Column) else F.lit(b))


def index_of(text, part: str) -> Column:
    """From 0; -1 if absent."""
    return F.instr(col(text), part) - 1


def substring(text, start: int, length: int | None = None) -> Column:
    """From 0."""
    return F.substring(col(text), start + 1, 2**31 - 1 if length is None else length)


def plus(*parts) -> Column:
    """Concatenation in which null is an empty text."""
    return F.concat(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def is_all_digits(text) -> Column:
    """ASCII digits, at least one; false for null."""
    return F.coalesce(col(text).rlike("^[0-9]+$") & ~col(text).endswith("\n"), F.lit(False))
