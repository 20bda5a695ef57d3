"""Settings of parallel execution, as far as Spark has a place for them."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    concurrency: int | None = None
    ordered_by: tuple[str, ...] = ()
    buffer: int | None = None
    timeout: float | None = 300.0
    continue_on_error: bool = False
    sequential: bool = False
    merge: str = "default"


@dataclass(frozen=True)
class Parallel:
    """A frame with settings; each method returns a new one."""

    df: DataFrame
    settings: Settings = Settings()

    def _set(self, **values: Any) -> Parallel:
        return replace(self, settings=replace(self.settings, **values))

    def with_max_concurrency(self, n: int) -> Parallel:
        if n <= 0:
            raise ValueError("concurrency must be positive")
        return self._set(concurrency=min(n, 100))

    def with_order_preservation(self, *keys: str) -> Parallel:
        return self._set(ordered_by=keys)

    def with_buffer_size(self, n: int) -> Parallel:
        return self._set(buffer=min(max(n, 10), 10_000))

    def with_timeout(self, seconds: float) -> Parallel:
        return self._set(timeout=seconds)

    def continue_on_error(self, on: bool = True) -> Parallel:
        return self._set(continue_on_error=on)

    def with_merge_options(self, merge: str) -> Parallel:
        """default, not_buffered, auto_buffered or fully_buffered: kept, but Spark has no place for it."""
        if merge not in ("default", "not_buffered", "auto_buffered", "fully_buffered"):
            raise ValueError(merge)
        return self._set(merge=merge)

    def sequential(self) -> Parallel:
        return self._set(sequential=True)

    def select(self, *columns) -> Parallel:
        return replace(self, df=self.df.select(*columns))

    def where(self, condition) -> Parallel:
        return replace(self, df=self.df.filter(condition))

    def take(self, n: int) -> Parallel:
        return replace(self, df=self.df.limit(n))

    def select_many(self, collection, name: str = "item") -> Parallel:
        return replace(self, df=self.df.select(F.explode(collection).alias(name)))

    def map_rows(self, f: Callable[[dict], dict | None], schema: str) -> Parallel:
        """An opaque function over rows in Arrow batches; None leaves a row out, as does a fault under continue_on_error."""
        skip, names = self.settings.continue_on_error, [x.name for x in self.df.sparkSession.createDataFrame([], schema).schema]

        def one(row: dict) -> dict | None:
            try:
                return f(row)
            except Exception:
                if skip:
                    return None
                raise

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([r for r in map(one, b.to_dict("records")) if r is not None], columns=names)

        return replace(self, df=self.plan().mapInPandas(run, schema), settings=replace(self.settings, ordered_by=self.settings.ordered_by))

    def plan(self) -> DataFrame:
        """The frame with the settings applied."""
        s, df = self.settings, self.df
        if s.sequential:
            df = df.coalesce(1)
        elif s.concurrency:
            df = df.repartition(s.concurrency)
        return df.orderBy(*s.ordered_by) if s.ordered_by else df

    def collect(self) -> list:
        """Runs under the timeout; the group's jobs are cancelled when it is over."""
        with cancellable(self.df, self.settings.timeout):
            return self.plan().collect()


@contextmanager
def cancellable(df: DataFrame, timeout: float | None = None, group: str = "sluice"):
    sc = df.sparkSession.sparkContext
    sc.setJobGroup(group, "cancellable", interruptOnCancel=True)
    timer = threading.Timer(timeout, lambda: sc.cancelJobGroup(group)) if timeout else None
    if timer:
        timer.daemon = True
        timer.start()
    try:
        yield lambda: sc.cancelJobGroup(group)
    finally:
        if timer:
            timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def as_parallel(df: DataFrame, settings: Settings | None = None) -> Parallel:
    return Parallel(df, settings or Settings())
