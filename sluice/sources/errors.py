"""What happens to records that can't be read: policies, error rows, sinks and counters."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_SCHEMA = (
    "reader string, file_path string, line_number long, record_number long, error_type string, message string, "
    "raw_excerpt string, action_chosen string, timestamp_utc timestamp"
)
EXCERPT = 128


class Action(Enum):
    """THROW fails the read, SKIP leaves the record out, STOP keeps the records before the first bad one."""

    THROW = "Throw"
    SKIP = "Skip"
    STOP = "Stop"


class BadRecord(ValueError):
    """A record that THROW met."""


class ErrorSink:
    def report(self, errors: DataFrame) -> None:
        raise NotImplementedError


class NullSink(ErrorSink):
    def report(self, errors: DataFrame) -> None:
        pass


@dataclass
class JsonLinesSink(ErrorSink):
    """Error rows as JSON lines with the keys of an error log, appended to a folder."""

    path: str
    append: bool = True

    def report(self, errors: DataFrame) -> None:
        rows = errors.select(
            F.col("timestamp_utc").alias("ts"), "reader", F.col("file_path").alias("file"), F.col("line_number").alias("line"), F.col("record_number").alias("record"),
            F.col("error_type").alias("errorType"), "message", F.col("raw_excerpt").alias("excerpt"), F.col("action_chosen").alias("action"),
        )
        rows.write.mode("append" if self.append else "overwrite").json(self.path)


@dataclass
class TableSink(ErrorSink):
    """Error rows appended to a table: a dead-letter store."""

    name: str

    def report(self, errors: DataFrame) -> None:
        errors.write.mode("append").saveAsTable(self.name)


@dataclass
class CallbackSink(ErrorSink):
    """on_error(excerpt, BadRecord) for each error, on the driver, a partition at a time."""

    on_error: Callable[[str, BadRecord], object]

    def report(self, errors: DataFrame) -> None:
        for e in errors.toLocalIterator():
            self.on_error(e["raw_excerpt"], BadRecord(f"{e['error_type']}: {e['message']} | excerpt: {e['raw_excerpt']}"))


@dataclass
class Metrics:
    """Counters of a read or write; filled when Result.finish() or a writer has run."""

    lines_read: int = 0
    raw_records: int = 0
    emitted: int = 0
    errors: int = 0
    terminated_early: bool = False
    started: float = field(default_factory=time.time)
    completed: float | None = None


@dataclass(frozen=True)
class Progress:
    lines_read: int
    records_read: int
    error_count: int
    elapsed: float
    percentage: float | None = None


@dataclass
class ReadOptions:
    """Shared by all readers. on_error alone means SKIP."""

    action: Action = Action.THROW
    sink: ErrorSink | None = None
    on_error: Callable[[str, BadRecord], object] | None = None
    metrics: Metrics | None = None
    progress: Callable[[Progress], object] | None = None

    def policy(self) -> Action:
        return Action.SKIP if self.on_error is not None and self.action is Action.THROW else self.action

    def sinks(self) -> list[ErrorSink]:
        return [s for s in (self.sink, CallbackSink(self.on_error) if self.on_error else None) if s is not None]


@dataclass
class Result:
    """Records (df) and errors of a read. Both are lazy; finish() reports errors and fills the metrics."""

    df: DataFrame
    errors: DataFrame
    options: ReadOptions

    def finish(self) -> Result:
        kept = self.errors.persist()
        for sink in self.options.sinks():
            try:
                sink.report(kept)
            except Exception:  # a sink that fails must not fail the read
                continue
        m = self.options.metrics
        if m is not None or self.options.progress is not None:
            n, bad = self.df.count(), kept.count()
            if m is not None:
                m.emitted, m.errors, m.raw_records, m.completed = n, bad, n + bad, time.time()
                m.terminated_early = self.options.policy() is Action.STOP and bad > 0
            if self.options.progress is not None:
                self.options.progress(Progress(n + bad, n, bad, time.time() - (m.started if m else time.time()), 100.0))
        kept.unpersist()
        return self


def split(rows: DataFrame, reader: str, options: ReadOptions, keep: list[str | Column], position: str = "_record") -> Result:
    """rows with _error (struct<type, message>, null if fine), _file, _line, a position and _raw, as records and errors by the policy."""
    policy = options.policy()
    bad = F.col("_error").isNotNull()
    errors = rows.filter(bad).select(
        F.lit(reader).alias("reader"), F.col("_file").alias("file_path"), F.col("_line").cast("long").alias("line_number"), F.col(position).cast("long").alias("record_number"),
        F.col("_error.type").alias("error_type"), F.col("_error.message").alias("message"), F.substring("_raw", 1, EXCERPT).alias("raw_excerpt"),
        F.lit(policy.value).alias("action_chosen"), F.current_timestamp().alias("timestamp_utc"),
    )
    if policy is Action.THROW:
        text = F.concat_ws(" ", F.lit(f"{reader}:"), F.col("_error.type"), F.col("_error.message"), F.lit("record"), F.col(position).cast("string"))
        good = rows.filter(F.when(bad, F.raise_error(text).cast("boolean")).otherwise(True))
    elif policy is Action.SKIP:
        good = rows.filter(~bad)
    else:
        # Everything of the file before its first bad record; one row for each file with errors.
        first = rows.filter(bad).groupBy("_file").agg(F.min(position).alias("_first"))
        good = rows.join(first, "_file", "left").filter(F.col("_first").isNull() | (F.col(position) < F.col("_first")))
    return Result(good.select(*keep), errors, options)


def error(kind: str, message: str | Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def no_error() -> Column:
    return F.lit(None).cast("struct<type:string,message:string>")


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False)
