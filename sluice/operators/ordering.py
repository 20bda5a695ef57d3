"""Order: total keys, dense positions, and cuts that need no global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.storage import scratch

POSITION = "_pos"


class NoOrder(ValueError):
    """A positional operator on a frame that nobody ordered."""


def names(keys) -> list[str]:
    keys = [keys] if isinstance(keys, str) else list(keys or ())
    if not keys:
        raise NoOrder("a positional operator needs an order key")
    return keys


def key_struct(keys) -> Column:
    return F.struct(*[F.col(k) for k in names(keys)])


def ranged(df: DataFrame, keys, n: int | None = None) -> DataFrame:
    """df written once in the order of keys, in ranges of all of them: adds _part, the range, and _row, the place in it.

    Ranges come from Spark's own sample of whole keys, so a value of the first key that
    many rows share is cut too. What is written is read by every later step: a source
    that changes in between can't give two orders.
    """
    keys, spark = [F.col(k) for k in names(keys)], df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = [c for c, kind in df.dtypes if kind == "void"]
    sorted_ = df.drop(*none).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    path = scratch(spark, "ranged")
    sorted_.write.parquet(path)
    kept = spark.read.schema(sorted_.schema).parquet(path)
    part, row = F.shiftright("_place", 33).cast("int"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.select(*[F.lit(None).alias(c) if c in none else F.col(f"`{c}`") for c in df.columns], part.alias("_part"), row.alias("_row"))


def starts(kept: DataFrame, sum_: Column) -> DataFrame:
    """_part, _start: what the earlier ranges add up to. A row for each range, which tasks bound."""
    before, rows = 0, []
    for r in sorted(kept.groupBy("_part").agg(sum_.cast("long").alias("n")).collect()):
        rows.append((r["_part"], before))
        before += r["n"]
    return F.broadcast(kept.sparkSession.createDataFrame(rows, "_part int, _start long"))


def positions(df: DataFrame, keys, name: str = POSITION, buckets: int | None = None) -> DataFrame:
    """Adds the dense position from 0 in the order of keys, which must be total: the place in its range and the sizes of earlier ranges."""
    kept = ranged(df, keys, buckets)
    placed = kept.join(starts(kept, F.count(F.lit(1))), "_part")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("_start") + F.col("_row")).alias(name))


def running(df: DataFrame, keys, value: Column, name: str) -> DataFrame:
    """Adds the sum of value over all rows up to and including each, in the order of keys; no step sees all rows."""
    kept = ranged(df.withColumn(name, value.cast("long")), keys)
    w = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = kept.join(starts(kept, F.coalesce(F.sum(name), F.lit(0))), "_part")
    return own.withColumn(name, F.col("_start") + F.coalesce(F.sum(name).over(w), F.lit(0))).drop("_part", "_row", "_start")


def edge(df: DataFrame, keys, condition: Column) -> DataFrame:
    """One row: the smallest key of the rows that meet the condition, null if there are none."""
    return df.filter(condition).agg(F.min(key_struct(keys)).alias("_edge"))


def cut(df: DataFrame, keys, condition: Column, keep: str) -> DataFrame:
    """Rows on one side of the first row that meets the condition: an aggregate, and a filter by its one row.

    keep: "before", "through" or "from" that row. Without such a row, "before" and
    "through" keep all rows and "from" none.
    """
    key = key_struct(keys)
    tests = {"before": key < F.col("_edge"), "through": key <= F.col("_edge"), "from": key >= F.col("_edge")}
    test = F.coalesce(tests[keep], F.lit(keep != "from"))
    # A broadcast of exactly one row.
    return df.join(F.broadcast(edge(df, keys, condition)), how="cross").filter(test).select(*[F.col(f"`{c}`") for c in df.columns])
