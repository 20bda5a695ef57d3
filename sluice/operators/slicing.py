"""Slices, limits and early exit over ordered rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sluice.operators.ordering import POSITION, cut, names, positions


def ordered(df: DataFrame, keys) -> DataFrame:
    return df.orderBy(*[F.col(k) for k in names(keys)])


def take(df: DataFrame, keys, count: int) -> DataFrame:
    """The first count rows; none if count is not positive."""
    return ordered(df, keys).limit(max(count, 0))


def take_slice(df: DataFrame, keys, start: int, count: int) -> DataFrame:
    if start < 0 or count < 0:
        raise ValueError("start and count can't be negative")
    return ordered(df, keys).offset(start).limit(count)


def take_range(df: DataFrame, keys, part: slice | range) -> DataFrame:
    """A half-open range of positions; places from the end are refused."""
    start, stop = part.start or 0, part.stop
    if (part.step or 1) != 1 or start < 0 or (stop is not None and stop < 0):
        raise ValueError("a range counts from the start, in steps of one")
    return skip(df, keys, start) if stop is None else take_slice(df, keys, start, max(stop - start, 0))


def skip(df: DataFrame, keys, count: int) -> DataFrame:
    """All rows but the first count. An offset would bring all rows to one task; positions don't."""
    return positions(df, keys).filter(F.col(POSITION) >= count).drop(POSITION) if count > 0 else df


def take_while(df: DataFrame, keys, condition: Column) -> DataFrame:
    """Rows before the first that fails; null fails."""
    return cut(df, keys, ~F.coalesce(condition, F.lit(False)), "before")


def skip_while(df: DataFrame, keys, condition: Column) -> DataFrame:
    """Rows from the first that fails on."""
    return cut(df, keys, ~F.coalesce(condition, F.lit(False)), "from")


def skip_while_indexed(df: DataFrame, keys, condition: Callable[[Column], Column]) -> DataFrame:
    """condition takes the position."""
    return skip_while(positions(df, keys), [POSITION], condition(F.col(POSITION))).drop(POSITION)


def until(df: DataFrame, keys, stop: Column) -> DataFrame:
    """Rows up to and including the first that meets stop."""
    return cut(df, keys, stop, "through")


def until_indexed(df: DataFrame, keys, stop: Callable[[Column], Column]) -> DataFrame:
    return until(positions(df, keys), [POSITION], stop(F.col(POSITION))).drop(POSITION)


def until_index(df: DataFrame, keys, last: int) -> DataFrame:
    """Rows 0 to last; none if last is negative."""
    return take(df, keys, last + 1)


def until_signal(df: DataFrame, keys, stop: Callable[[], bool]) -> Iterator[Row]:
    """Rows on the driver until stop(), asked after each, is true; that row is included."""
    for row in ordered(df, keys).toLocalIterator():
        yield row
        if stop():
            return


def first(df: DataFrame, keys, condition: Column | None = None) -> Row:
    """The first matching row; LookupError if there is none."""
    row = first_or_default(df, keys, condition)
    if row is None:
        raise LookupError("no matching row")
    return row


def first_or_default(df: DataFrame, keys, condition: Column | None = None, default: Row | None = None) -> Row | None:
    found = df if condition is None else df.filter(condition)
    rows = take(found, keys, 1).collect()
    return rows[0] if rows else default


def single(df: DataFrame) -> Row:
    """The only row; LookupError for none, ValueError for more."""
    rows = df.limit(2).collect()
    if not rows:
        raise LookupError("no row")
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0]


def single_or_default(df: DataFrame, default: Row | None = None) -> Row | None:
    return single(df) if not df.isEmpty() else default


class Cursor:
    """Steps through a frame on the driver, a partition at a time."""

    def __init__(self, df: DataFrame):
        self._rows = df.toLocalIterator()

    def try_next(self) -> tuple[bool, Row | None]:
        for row in self._rows:
            return True, row
        return False, None

    def next_or_default(self, default: Row | None = None) -> Row | None:
        return next(self._rows, default)
