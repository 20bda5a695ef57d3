"""Joins, grouping and windows with the names of the fluent surface."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def join(left: DataFrame, right: DataFrame, left_keys: str | Sequence[str], right_keys: str | Sequence[str], kind: str = "inner") -> DataFrame:
    """Equality on one or more keys; Catalyst picks the strategy. Kinds: inner, left, right, outer or full."""
    left_keys = [left_keys] if isinstance(left_keys, str) else list(left_keys)
    right_keys = [right_keys] if isinstance(right_keys, str) else list(right_keys)
    on = None
    for a, b in zip(left_keys, right_keys, strict=True):
        test = left[a] == right[b]
        on = test if on is None else on & test
    return left.join(right, on, KINDS[kind.lower()])


def group_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *aggregates: Column, name: str = "items") -> DataFrame:
    """Each left row with its matches: the aggregates given, or all of them as an array.

    The right side is grouped by its key before it joins, so no left row is repeated.
    """
    what = list(aggregates) or [F.collect_list(F.struct(*[F.col(f"`{c}`") for c in right.columns])).alias(name)]
    grouped = right.groupBy(F.col(right_key).alias("_k")).agg(*what)
    return left.join(grouped, left[left_key] == grouped["_k"], "left").drop("_k")


def group(df: DataFrame, keys: Sequence[str | Column], *aggregates: Column, having: Column | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(*aggregates)
    return out if having is None else out.filter(having)


class Over:
    """What a window offers: ranks, offsets and running aggregates."""

    def __init__(self, spec: WindowSpec, order: Sequence[Column]):
        self.spec = spec
        self.running = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow) if order else spec

    def row_number(self) -> Column:
        return F.row_number().over(self.spec).cast("long")

    def rank(self) -> Column:
        return F.rank().over(self.spec).cast("long")

    def dense_rank(self) -> Column:
        return F.dense_rank().over(self.spec).cast("long")

    def percent_rank(self) -> Column:
        return F.percent_rank().over(self.spec)

    def ntile(self, n: int) -> Column:
        return F.ntile(n).over(self.spec).cast("long")

    def lag(self, value: str | Column, n: int = 1) -> Column:
        return F.lag(value, n).over(self.spec)

    def lead(self, value: str | Column, n: int = 1) -> Column:
        return F.lead(value, n).over(self.spec)

    def sum(self, value: str | Column) -> Column:
        return F.sum(value).over(self.running)

    def avg(self, value: str | Column) -> Column:
        return F.avg(value).over(self.running)

    def min(self, value: str | Column) -> Column:
        return F.min(value).over(self.running)

    def max(self, value: str | Column) -> Column:
        return F.max(value).over(self.running)

    def count(self) -> Column:
        return F.count(F.lit(1)).over(self.running)


def with_window(df: DataFrame, partition: Sequence[str], order: Sequence[Column], columns: Callable[[Over], dict[str, Column]]) -> DataFrame:
    """Adds the columns that the callable builds over PARTITION BY and ORDER BY; ordered aggregates run up to the row."""
    spec = Window.partitionBy(*partition)
    return df.withColumns(columns(Over(spec.orderBy(*order) if order else spec, order)))


def with_row_number(df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str = "row_number") -> DataFrame:
    return with_window(df, partition, order, lambda w: {name: w.row_number()})


def with_rank(df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return with_window(df, partition, order, lambda w: {name: w.rank()})
