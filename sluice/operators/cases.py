"""Case routing: categorise each row once, then transform or write it by category."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.ordering import POSITION, positions

CATEGORY, ITEM, NEW = "category", "item", "new_item"
Selector = Column | Callable[..., Column] | None


def routed(conditions: Sequence[Column]) -> Column:
    """The index of the first condition that holds, their number if none does; null holds not."""
    out = F.lit(len(conditions))
    for k, c in reversed(list(enumerate(conditions))):
        out = F.when(c, k).otherwise(out)
    return out.cast("int")


def cases(df: DataFrame, *conditions: Column) -> DataFrame:
    """Adds category."""
    return df.withColumn(CATEGORY, routed(conditions))


def cases_by_key(df: DataFrame, key: str | Column, *values: Any) -> DataFrame:
    """category is the place of the key in values, their number for others. Values must differ."""
    if len(set(values)) < len(values):
        raise ValueError("values must differ")
    key = F.col(key) if isinstance(key, str) else key
    return df.withColumn(CATEGORY, routed([key.eqNullSafe(F.lit(v)) for v in values]))


def chosen(selectors: Sequence[Selector], *args: Column) -> Column:
    """The selector of the row's category; categories without one have null. All selectors have one type."""
    out = F.lit(None)
    for k, s in reversed(list(enumerate(selectors))):
        if s is not None:
            out = F.when(F.col(CATEGORY) == k, s(*args) if callable(s) else s).otherwise(out)
    return out


def select_case(df: DataFrame, *selectors: Selector) -> DataFrame:
    """Adds new_item; on a frame that has it, a callable selector takes the present new_item (the second stage)."""
    second = NEW in df.columns
    if not second and any(callable(s) for s in selectors):
        raise ValueError("before the first stage a selector is a column")
    return df.withColumn(NEW, chosen(selectors, *([F.col(NEW)] if second else [])))


def select_case_indexed(df: DataFrame, keys, *selectors: Callable[..., Column] | None) -> DataFrame:
    """Selectors take the position among all rows, in the second stage after new_item."""
    args = ([F.col(NEW)] if NEW in df.columns else []) + [F.col(POSITION)]
    return positions(df, keys).withColumn(NEW, chosen(selectors, *args)).drop(POSITION)


def select_cases(df: DataFrame, *selectors: Selector) -> DataFrame:
    """A column result_1..result_N for each category, each of its own type; only the row's own is filled."""
    if not 2 <= len(selectors) <= 7:
        raise ValueError("two to seven selectors")
    return df.withColumns({f"result_{k + 1}": F.when(F.col(CATEGORY) == k, s) for k, s in enumerate(selectors)})


def results(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c.startswith("result_")), key=lambda c: int(c[7:]))


def uncase(df: DataFrame) -> DataFrame:
    """The rows as they were before cases()."""
    return df.drop(CATEGORY, NEW, *results(df))


def all_cases(df: DataFrame, drop_null: bool = True) -> DataFrame:
    """new_item alone; only nulls are dropped, zeros and false stay."""
    out = df.select(NEW)
    return out.filter(F.col(NEW).isNotNull()) if drop_null else out


def all_cases_multi(df: DataFrame) -> DataFrame:
    """The filled result of each row as `result`; slots of several types become JSON text. Nulls are dropped."""
    slots = results(df)
    types = {df.schema[c].dataType for c in slots}
    one = [F.col(c) if len(types) == 1 else F.to_json(F.struct(F.col(c).alias("value"))) for c in slots]
    filled = [F.when(F.col(c).isNotNull(), x) for c, x in zip(slots, one, strict=True)]
    return df.select(F.coalesce(*filled).alias("result")).filter("result IS NOT NULL")


def for_each_case(df: DataFrame, *actions: Callable[[DataFrame], Any] | None) -> DataFrame:
    """Runs each action on its category's rows (new_item, if there is one, stays in them) and returns df. The rows are computed once."""
    kept = df.persist()
    try:
        for k, act in enumerate(actions):
            if act is not None:
                act(kept.filter(F.col(CATEGORY) == k))
    finally:
        kept.unpersist()
    return df


def for_each_cases(df: DataFrame, *actions: Callable[[DataFrame], Any] | None) -> DataFrame:
    """Typed form: action k sees the rows whose result_k is filled."""
    kept = df.persist()
    try:
        for k, act in enumerate(actions):
            if act is not None:
                act(kept.filter((F.col(CATEGORY) == k) & F.col(f"result_{k + 1}").isNotNull()))
    finally:
        kept.unpersist()
    return df


def count_cases(df: DataFrame) -> DataFrame:
    """Rows of each category: the counters that per-row actions would keep, as one aggregation."""
    return df.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("n"))


def write_tables(df: DataFrame, *tables: str | None, mode: str = "append") -> DataFrame:
    """Each category to a table of its own, without the category."""
    save = lambda name: lambda rows: uncase(rows).write.mode(mode).saveAsTable(name)
    return for_each_case(df, *[None if t is None else save(t) for t in tables])


def merge_tables(df: DataFrame, *targets: tuple[str, str | Sequence[str]] | None) -> DataFrame:
    """Each category upserted into its own table by its own key."""
    from sluice.operators.merge import merge_table

    put = lambda name, key: lambda rows: merge_table(rows.sparkSession, name, uncase(rows), key)
    return for_each_case(df, *[None if t is None else put(*t) for t in targets])


@dataclass(frozen=True)
class Noted:
    """A frame with a context value for conditions and selectors."""

    df: DataFrame
    note: Any

    def __iter__(self):
        return iter((self.df, self.note))

    def cases(self, *conditions: Callable[[Any], Column]) -> Noted:
        return Noted(cases(self.df, *[c(self.note) for c in conditions]), self.note)

    def select_case(self, *selectors: Callable[..., Column] | None) -> Noted:
        if NEW in self.df.columns:
            second = [None if s is None else (lambda x, s=s: s(x, self.note)) for s in selectors]
            return Noted(select_case(self.df, *second), self.note)
        return Noted(select_case(self.df, *[None if s is None else s(self.note) for s in selectors]), self.note)

    def for_each_case(self, *actions: Callable[[DataFrame, Any], Any] | None) -> Noted:
        return Noted(for_each_case(self.df, *[None if a is None else (lambda rows, a=a: a(rows, self.note)) for a in actions]), self.note)

    def without_note(self, close: Callable[[Any], Any] | None = None) -> DataFrame:
        if close is not None:
            close(self.note)
        return self.df


def with_note(df: DataFrame, note: Any) -> Noted:
    return Noted(df, note)
