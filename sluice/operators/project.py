"""Projection, filtering and flattening."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.ordering import POSITION, positions, running


def select_indexed(df: DataFrame, keys, *columns: Callable[[Column], Column]) -> DataFrame:
    """Each argument builds a column from the position."""
    return positions(df, keys).select(*[c(F.col(POSITION)) for c in columns])


def where_indexed(df: DataFrame, keys, condition: Callable[[Column], Column]) -> DataFrame:
    return positions(df, keys).filter(condition(F.col(POSITION))).drop(POSITION)


def select_many(df: DataFrame, collection: Column, name: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each element; null and empty collections give none. keep carries parent columns along."""
    return df.select(*keep, F.explode(collection).alias(name))


def select_many_indexed(df: DataFrame, keys, collection: Callable[[Column], Column], name: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """collection takes the parent's position; the element's own place is in `index`."""
    return positions(df, keys).select(*keep, F.posexplode(collection(F.col(POSITION))).alias("index", name)).withColumn("index", F.col("index").cast("long"))


def flatten(df: DataFrame, collection: str, separator: Column | None = None, name: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """Elements of inner collections with their place (`index`). A separator follows every inner collection, null and last ones too."""
    inner = F.col(collection)
    if separator is not None:
        inner = F.concat(F.coalesce(inner, F.array().cast(df.schema[collection].dataType)), F.array(separator))
    return df.select(*keep, F.posexplode(inner).alias("index", name)).withColumn("index", F.col("index").cast("long"))


def append(df: DataFrame, row: DataFrame, keys) -> DataFrame:
    """One row after all others, with _pos for the order."""
    return placed(df, row, keys, first=False)


def prepend(df: DataFrame, row: DataFrame, keys) -> DataFrame:
    return placed(df, row, keys, first=True)


def placed(df: DataFrame, row: DataFrame, keys, first: bool) -> DataFrame:
    """Rows keep their order by _order: struct(side, keys). Nothing is counted or moved."""
    side = lambda d, n: d.withColumn("_order", F.struct(F.lit(n).alias("side"), *[F.col(k) for k in keys]))
    return side(df, 1).unionByName(side(row, 0 if first else 2), allowMissingColumns=True)


def to_lines(df: DataFrame, slices: str, separator: str, keys, partition: tuple[str, ...] = ()) -> DataFrame:
    """Slices joined up to each that equals the separator; a tail without one is dropped. Columns: partition, line_no, line.

    Without a partition, separators are counted over ranges of the keys; only a line's own slices meet in a task.
    """
    from pyspark.sql import Window

    ends = F.col(slices) == separator
    if partition:
        w = Window.partitionBy(*partition).orderBy(*[F.col(k) for k in keys])
        numbered = df.withColumn("_line", F.sum(ends.cast("int")).over(w) - ends.cast("int"))
    else:
        numbered = running(df, keys, F.coalesce(ends, F.lit(False)).cast("int"), "_line").withColumn("_line", F.col("_line") - F.coalesce(ends, F.lit(False)).cast("int"))
    order = F.struct(*[F.col(k) for k in keys], F.col(slices).alias("_slice"))
    lines = numbered.groupBy(*partition, "_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~ends, order))), lambda x: x["_slice"]), "").alias("line"),
        F.bool_or(ends).alias("_whole"),
    )
    return lines.filter("_whole").select(*partition, F.col("_line").cast("long").alias("line_no"), "line")


def buffer(df: DataFrame, keys, size: int) -> DataFrame:
    """chunk, items: consecutive rows in arrays of size; the last may be short."""
    if size <= 0:
        raise ValueError("a chunk holds one row at least")
    at = positions(df, keys)
    row = F.struct(POSITION, *[F.col(f"`{c}`") for c in df.columns])
    chunks = at.groupBy(F.expr(f"{POSITION} div {size}").alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("items"))
    return chunks.withColumn("items", F.transform("items", lambda x: x.dropFields(POSITION)))
