"""A fluent chain over a DataFrame and its order key. It keeps no plan of its own: every step is a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession

from sluice.operators import aggregate, cases, inspect, merge, project, relational, sets, slicing
from sluice.operators.ordering import NoOrder
from sluice.operators.parallel import Parallel, as_parallel
from sluice.sources import writers


class Flow:
    """df and the names of the columns that order it; positional steps raise without them."""

    def __init__(self, df: DataFrame, keys: Sequence[str] = ()):
        self.df, self.keys = df, tuple(keys)

    @staticmethod
    def table(spark: SparkSession, name: str, *keys: str) -> Flow:
        return Flow(spark.table(name), keys)

    @staticmethod
    def sql(spark: SparkSession, text: str, *keys: str) -> Flow:
        return Flow(spark.sql(text), keys)

    def _next(self, df: DataFrame, keys: Sequence[str] | None = None) -> Flow:
        return Flow(df, self.keys if keys is None else keys)

    def _ordered(self) -> tuple[str, ...]:
        if not self.keys:
            raise NoOrder("order the flow first: ordered_by(...)")
        return self.keys

    def ordered_by(self, *keys: str) -> Flow:
        """Declares a total order; nothing is sorted."""
        return self._next(self.df, keys)

    # Projection and filters
    def where(self, condition: Column | str) -> Flow:
        return self._next(self.df.filter(condition))

    def where_indexed(self, condition: Callable[[Column], Column]) -> Flow:
        return self._next(project.where_indexed(self.df, self._ordered(), condition))

    def select(self, *columns: Column | str) -> Flow:
        return self._next(self.df.select(*columns))

    def select_indexed(self, *columns: Callable[[Column], Column]) -> Flow:
        return self._next(project.select_indexed(self.df, self._ordered(), *columns))

    def select_many(self, collection: Column, name: str = "item", keep: Sequence[str] = ()) -> Flow:
        return self._next(project.select_many(self.df, collection, name, tuple(keep)))

    def flatten(self, collection: str, separator: Column | None = None, keep: Sequence[str] = ()) -> Flow:
        return self._next(project.flatten(self.df, collection, separator, keep=tuple(keep)))

    def buffer(self, size: int) -> Flow:
        return self._next(project.buffer(self.df, self._ordered(), size), ["chunk"])

    # Slices
    def take(self, count: int) -> Flow:
        return self._next(slicing.take(self.df, self._ordered(), count))

    def take_slice(self, start: int, count: int) -> Flow:
        return self._next(slicing.take_slice(self.df, self._ordered(), start, count))

    def take_while(self, condition: Column) -> Flow:
        return self._next(slicing.take_while(self.df, self._ordered(), condition))

    def skip(self, count: int) -> Flow:
        return self._next(slicing.skip(self.df, self._ordered(), count))

    def skip_while(self, condition: Column) -> Flow:
        return self._next(slicing.skip_while(self.df, self._ordered(), condition))

    def until(self, stop: Column | int) -> Flow:
        """Through the first row that meets a condition, or through a position."""
        if isinstance(stop, int):
            return self._next(slicing.until_index(self.df, self._ordered(), stop))
        return self._next(slicing.until(self.df, self._ordered(), stop))

    # Cases
    def cases(self, *conditions: Column) -> Flow:
        return self._next(cases.cases(self.df, *conditions))

    def cases_by_key(self, key: str | Column, *values: Any) -> Flow:
        return self._next(cases.cases_by_key(self.df, key, *values))

    def select_case(self, *selectors) -> Flow:
        return self._next(cases.select_case(self.df, *selectors))

    def select_cases(self, *selectors) -> Flow:
        return self._next(cases.select_cases(self.df, *selectors))

    def for_each_case(self, *actions) -> Flow:
        return self._next(cases.for_each_case(self.df, *actions))

    def all_cases(self, drop_null: bool = True) -> Flow:
        multi = cases.NEW not in self.df.columns
        return self._next(cases.all_cases_multi(self.df) if multi else cases.all_cases(self.df, drop_null), ())

    def uncase(self) -> Flow:
        return self._next(cases.uncase(self.df))

    def write_tables(self, *tables: str | None) -> Flow:
        return self._next(cases.write_tables(self.df, *tables))

    def with_note(self, note: Any) -> cases.Noted:
        return cases.with_note(self.df, note)

    # Relational
    def order_by(self, *columns: Column | str) -> Flow:
        """Sorts, and takes plain column names as the order of positional steps."""
        return self._next(self.df.orderBy(*columns), [c for c in columns if isinstance(c, str)] or self.keys)

    def group_by(self, keys: Sequence[str | Column], *aggregates: Column, having: Column | None = None) -> Flow:
        return self._next(relational.group(self.df, keys, *aggregates, having=having), [k for k in keys if isinstance(k, str)])

    def join(self, other: Flow | DataFrame, left: str | Sequence[str], right: str | Sequence[str], kind: str = "inner") -> Flow:
        return self._next(relational.join(self.df, frame(other), left, right, kind))

    def group_join(self, other: Flow | DataFrame, left: str, right: str, *aggregates: Column) -> Flow:
        return self._next(relational.group_join(self.df, frame(other), left, right, *aggregates))

    def with_window(self, partition: Sequence[str], order: Sequence[Column], columns: Callable[[relational.Over], dict[str, Column]]) -> Flow:
        return self._next(relational.with_window(self.df, partition, order, columns))

    # Sets
    def distinct(self, *equal: Column) -> Flow:
        """Equal rows once; with expressions, the first row of those that are equal by them."""
        return self._next(sets.distinct_first(self.df, self._ordered(), *equal) if equal else self.df.distinct())

    def concat(self, other: Flow | DataFrame) -> Flow:
        return self._next(sets.concat(self.df, frame(other)), ["_src", *self.keys])

    def union(self, other: Flow | DataFrame) -> Flow:
        return self._next(sets.union(self.df, frame(other)))

    def union_distinct(self, other: Flow | DataFrame) -> Flow:
        return self._next(sets.union_distinct(self.df, frame(other)))

    def intersect(self, other: Flow | DataFrame) -> Flow:
        return self._next(sets.intersect(self.df, frame(other)))

    def except_(self, other: Flow | DataFrame) -> Flow:
        return self._next(sets.except_(self.df, frame(other)))

    def merge_ordered(self, other: Flow | DataFrame) -> Flow:
        return self._next(sets.merge_ordered(self.df, frame(other), self._ordered()), [*self.keys, "_src"])

    # Execution
    def as_parallel(self) -> Parallel:
        return as_parallel(self.df)

    def cache(self) -> Flow:
        return self._next(self.df.cache())

    def repartition(self, n: int, *columns: str) -> Flow:
        return self._next(self.df.repartition(n, *columns))

    def spy(self, tag: str, n: int = 20) -> Flow:
        return self._next(inspect.spy(self.df, tag, n))

    # Ends
    def to_list(self) -> list[Row]:
        return (self.df.orderBy(*self.keys) if self.keys else self.df).collect()

    def pull(self) -> Iterator[Row]:
        return self.df.toLocalIterator(prefetchPartitions=True)

    def first(self, condition: Column | None = None) -> Row:
        return slicing.first(self.df, self._ordered(), condition)

    def first_or_default(self, condition: Column | None = None, default: Row | None = None) -> Row | None:
        return slicing.first_or_default(self.df, self._ordered(), condition, default)

    def single(self) -> Row:
        return slicing.single(self.df)

    def count(self, condition: Column | None = None) -> int:
        return (self.df if condition is None else self.df.filter(condition)).count()

    def any(self, condition: Column | None = None) -> bool:
        return aggregate.any_(self.df, condition)

    def all(self, condition: Column) -> bool:
        return aggregate.all_(self.df, condition)

    def aggregate(self, value: Column, seed: Column, step: Callable[[Column, Column], Column]) -> Any:
        return aggregate.fold(self.df, value, self._ordered(), seed, step).first()["result"]

    def build_string(self, value: Column, separator: str = ", ", before: str = "{", after: str = "}") -> str:
        row = aggregate.build_string(self.df, value, self._ordered(), separator, before, after).first()
        return row["text"]

    def to_dictionary(self, key: str, value: str) -> dict:
        return aggregate.to_dictionary(self.df, key, value)

    def do(self, action: Callable[[Row], Any] | None = None) -> None:
        aggregate.do(self.df, action)

    def write_csv(self, path: str, options: writers.CsvWriteOptions | None = None) -> None:
        writers.csv(self.df, path, options)

    def write_json(self, path: str, options: writers.JsonWriteOptions | None = None) -> None:
        writers.json_(self.df, path, options)

    def write_yaml(self, path: str, options: writers.YamlWriteOptions | None = None) -> None:
        writers.yaml_(self.df, path, options)

    def write_text(self, path: str, value: str = "value") -> None:
        writers.text(self.df, path, value=value)

    def write_parquet(self, path: str, partition_by: Sequence[str] = ()) -> None:
        writers.parquet(self.df, path, partition_by=partition_by)

    def write_table(self, name: str, overwrite: bool = False, create_if_missing: bool = True) -> None:
        merge.write_table(self.df, name, create_if_missing, overwrite)

    def merge_table(self, name: str, key: str | Sequence[str], only: Sequence[str] | None = None) -> None:
        merge.merge_table(self.df.sparkSession, name, self.df, key, only)

    def explain(self, mode: str = "formatted") -> str:
        return inspect.explain(self.df, mode)


def frame(other: Flow | DataFrame) -> DataFrame:
    return other.df if isinstance(other, Flow) else other


def flow(rows: DataFrame, *keys: str) -> Flow:
    return Flow(rows, keys)


