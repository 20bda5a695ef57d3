"""Numbers, dates and maps with the conventions of the fluent surface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.text import col


def round_half_up(x, scale: int = 0) -> Column:
    """As SQL rounds."""
    return F.round(col(x), scale)


def round_half_even(x, scale: int = 0) -> Column:
    """As IEEE rounds."""
    return F.bround(col(x), scale)


def int_div(a, b) -> Column:
    """Integer division, truncated."""
    a, b = col(a), b if isinstance(b, Column) else F.lit(b)
    q = a / b
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def is_multiple(x, of: int) -> Column:
    """x % of == 0; of 0 raises."""
    return col(x) % of == 0


def day_of_week(d) -> Column:
    """Sunday is 0."""
    return F.dayofweek(col(d)) - 1


def add_days(d, n) -> Column:
    return F.timestamp_add("DAY", n if isinstance(n, Column) else F.lit(n), col(d))


def add_or_update(map_, key, value) -> Column:
    """A map with the entry set. Keys stay unique without a session setting."""
    rest = F.map_filter(col(map_), lambda k, _: k != F.lit(key))
    return F.map_concat(rest, F.create_map(F.lit(key), value if isinstance(value, Column) else F.lit(value)))


def was_added(map_, key) -> Column:
    """Whether add_or_update adds rather than updates."""
    return ~F.map_contains_key(col(map_), F.lit(key))


def get_or_null(map_, key) -> Column:
    return F.try_element_at(col(map_), F.lit(key))
