"""Folds, sums, existence and terminal results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def listed(value: Column, keys) -> Column:
    """Aggregate: the group's values as an array in the order of keys."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(k) for k in keys], value.alias("_v")))), lambda x: x["_v"])


def fold(df: DataFrame, value: Column, keys, seed: Column, step: Callable[[Column, Column], Column], group: Sequence[str] = (), name: str = "result") -> DataFrame:
    """An ordered left fold, of each group or of all rows. A fold that is associative belongs to a built-in aggregate instead.

    A fold takes one value after the other, so a group's values meet in one task, and without a group all of them do.
    """
    return df.groupBy(*group).agg(listed(value, keys).alias("_all")).select(*group, F.aggregate("_all", seed, step).alias(name))


def fold_first(df: DataFrame, value: Column, keys, step: Callable[[Column, Column], Column], group: Sequence[str] = (), name: str = "result") -> DataFrame:
    """A fold that starts with the first value; null for no rows."""
    all_ = df.groupBy(*group).agg(listed(value, keys).alias("_all"))
    first = F.get("_all", F.lit(0))
    return all_.select(*group, F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all"), F.lit(1))), first, step).alias(name))


def sum_int(value: Column) -> Column:
    """32-bit result; overflow raises. Sums over no rows are 0, in all kinds."""
    return F.coalesce(F.sum(value.cast("long")), F.lit(0)).cast("int")


def sum_long(value: Column) -> Column:
    """64-bit result; overflow raises."""
    return F.coalesce(F.sum(value.cast("long")), F.lit(0))


def sum_float(value: Column) -> Column:
    return F.coalesce(F.sum(value.cast("double")), F.lit(0.0)).cast("float")


def sum_decimal(value: Column, scale: int = 2) -> Column:
    """Exact."""
    return F.coalesce(F.sum(value.cast(f"decimal(28,{scale})")), F.lit(0).cast(f"decimal(38,{scale})"))


def any_(df: DataFrame, condition: Column | None = None) -> bool:
    return not (df if condition is None else df.filter(condition)).isEmpty()


def all_(df: DataFrame, condition: Column) -> bool:
    return df.filter(~F.coalesce(condition, F.lit(False))).isEmpty()


def is_null_or_empty(df: DataFrame | None) -> bool:
    return df is None or df.isEmpty()


def build_string(df: DataFrame, value: Column, keys, separator: str = ", ", before: str = "{", after: str = "}", group: Sequence[str] = (), name: str = "text") -> DataFrame:
    joined = F.array_join(F.transform(listed(value, keys), lambda x: F.coalesce(x.cast("string"), F.lit(""))), separator)
    return df.groupBy(*group).agg(F.concat(F.lit(before), joined, F.lit(after)).alias(name))


def to_list(df: DataFrame) -> list[Row]:
    return df.collect()


def to_dictionary(df: DataFrame, key: str, value: str) -> dict[Any, Any]:
    """A dict on the driver; a key that comes twice raises."""
    out: dict[Any, Any] = {}
    for k, v in df.select(key, value).toLocalIterator():
        if k in out:
            raise ValueError(f"key {k!r} comes twice")
        out[k] = v
    return out


def to_map(df: DataFrame, key: str, value: str, group: Sequence[str] = (), name: str = "map") -> DataFrame:
    """A map column of each group; a key that comes twice raises under Spark's default policy."""
    return df.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def do(df: DataFrame, action: Callable[[Row], Any] | None = None) -> None:
    """Runs the plan: for its side effects, or with an action on each row on the workers."""
    if action is None:
        df.write.format("noop").mode("overwrite").save()
    else:
        df.foreachPartition(lambda rows: [action(r) for r in rows] and None)


def for_each(df: DataFrame, action: Callable[[Any], Any]) -> DataFrame:
    """A lazy pass-through: the action sees each Arrow batch as a pandas frame on the workers. May run again if a task does."""

    def run(batches):
        for b in batches:
            action(b)
            yield b

    return df.mapInPandas(run, df.schema)


def for_each_async(df: DataFrame, action: Callable[[Row], Any], together: int = 64) -> None:
    """Awaits action(row) for each row; in each task, up to so many calls run together."""

    def run(rows):
        import asyncio

        async def all_():
            pending: set = set()
            for r in rows:
                pending.add(asyncio.ensure_future(action(r)))
                if len(pending) >= together:
                    done, pending = await asyncio.wait(pending, return_when=asyncio.FIRST_COMPLETED)
                    for d in done:
                        d.result()
            await asyncio.gather(*pending)

        asyncio.run(all_())

    df.foreachPartition(run)


def observed(df: DataFrame, **counters: Column):
    """(df with counters, Observation): counters are ready after an action, without a second pass."""
    from pyspark.sql import Observation

    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def long_accumulator(spark, start: int = 0):
    """A counter that actions on the workers add to, and the driver reads. Tasks that run again add again; observed() counts once."""
    return spark.sparkContext.accumulator(start)


def double_accumulator(spark, start: float = 0.0):
    return spark.sparkContext.accumulator(start)
