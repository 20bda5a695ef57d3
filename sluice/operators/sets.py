"""Set operations, ordered merging and unification of named sources."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_first(df: DataFrame, keys, *equal: Column) -> DataFrame:
    """The first row, in the order of keys, of those that are equal by the given expressions (all columns if none)."""
    by = list(equal) or [F.col(f"`{c}`") for c in df.columns]
    row = F.struct(*[F.col(k) for k in keys], *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)])
    # A minimum is summed up before it moves, unlike a row number.
    best = df.groupBy(*[c.alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.min(row).alias("_r"))
    return best.select(*[F.col("_r")[f"_c{i}"].alias(c) for i, c in enumerate(df.columns)])


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of both; _src (0, 1) keeps the order."""
    return first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*a.columns).intersect(b.select(*a.columns))


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*a.columns).subtract(b.select(*a.columns))


def merge_ordered(first: DataFrame, second: DataFrame, keys, place: str | None = None, ties=()) -> DataFrame:
    """Two sorted inputs as one in the order of keys; of ties the first input's come first.

    With place, rows get their place under that name instead of being sorted; ties names columns that tell equal rows of one input apart.
    """
    if place is not None:
        from sluice.operators.ordering import names, positions

        return positions(concat(first, second), [*names(keys), "_src", *ties], place)
    return concat(first, second).orderBy(*[F.col(k) for k in keys], "_src")


class ErrorMode(Enum):
    FAIL_FAST = "fail_fast"
    CONTINUE = "continue"


class Fairness(Enum):
    FIRST_AVAILABLE = "first_available"
    ROUND_ROBIN = "round_robin"


class SourceFailed(RuntimeError):
    pass


@dataclass
class Unified:
    """Named sources under one schema, each with a condition of its own. Frozen once read."""

    error_mode: ErrorMode = ErrorMode.FAIL_FAST
    fairness: Fairness = Fairness.FIRST_AVAILABLE
    _sources: list[tuple[str, DataFrame, Column | None]] = field(default_factory=list)
    _frozen: bool = False

    def unify(self, source: DataFrame, name: str, condition: Column | None = None) -> Unified:
        self._open()
        self._sources.append((name, source, condition))
        return self

    def unlisten(self, name: str) -> bool:
        """Takes the first source of that name out; false if there is none."""
        self._open()
        for k, (n, _, _) in enumerate(self._sources):
            if n == name:
                del self._sources[k]
                return True
        return False

    def _open(self) -> None:
        if self._frozen:
            raise RuntimeError("sources can't change once they are read")

    def read(self, keys=None) -> DataFrame:
        """The union with _source; round robin, batch only, adds _turn and _rank to order by and needs keys.

        A source that can't be analysed fails under its name, or is left out in CONTINUE mode.
        """
        self._frozen = True
        parts = []
        for k, (name, df, condition) in enumerate(self._sources):
            try:
                own = df if condition is None else df.filter(condition)
                own = own.withColumn("_source", F.lit(name))
                if self.fairness is Fairness.ROUND_ROBIN:
                    from sluice.operators.ordering import positions

                    own = positions(own, keys, "_turn").withColumn("_rank", F.lit(k))
                if parts:
                    parts[0].unionByName(own)  # names and types are compared here
            except Exception as e:
                if self.error_mode is ErrorMode.FAIL_FAST:
                    raise SourceFailed(f"source {name} failed") from e
                continue
            parts.append(own)
        if not parts:
            raise SourceFailed("no source is left")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def unify(first: tuple[DataFrame, str], second: DataFrame, name: str, error_mode: ErrorMode = ErrorMode.FAIL_FAST, fairness: Fairness = Fairness.ROUND_ROBIN) -> Unified:
    return Unified(error_mode, fairness).unify(*first).unify(second, name)


def first_by(df: DataFrame, partition, keys) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*[F.col(k) for k in keys])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
