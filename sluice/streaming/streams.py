"""Structured Streaming: polled sources, pacing, bounded buffers, unification and case sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery


class _PollReader(SimpleDataSourceStreamReader):
    def __init__(self, poll: Callable[[int], Sequence[tuple]]):
        self.poll = poll

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [r for r in self.poll(start["n"]) or () if r is not None]
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for r in self.poll(start["n"]) or () if r is not None][: end["n"] - start["n"]])


def poll_source(spark: SparkSession, name: str, poll: Callable[[int], Sequence[tuple]], schema: str) -> DataFrame:
    """A streaming frame of what poll(n) returns, n being the rows so far; None entries are left out.

    poll must give the same rows for the same n, so that a batch that is run again is
    the same. The interval is the trigger's; stop() of the query ends it.
    """

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _PollReader(poll)

    spark.dataSource.register(Polled)
    return spark.readStream.format(name).load()


def stop_when(df: DataFrame, stop: Callable[[DataFrame], bool], sink: Callable[[DataFrame], Any], interval: str = "1 second", checkpoint: str | None = None) -> StreamingQuery:
    """Runs the stream into the sink until stop(batch) is true; the batch that meets it is written. With a checkpoint, a restart goes on after the last batch."""
    box: dict[str, StreamingQuery] = {}

    def batch(rows: DataFrame, _: int) -> None:
        sink(rows)
        if stop(rows):
            import threading

            threading.Thread(target=lambda: box["q"].stop(), daemon=True).start()

    writer = df.writeStream.foreachBatch(batch).trigger(processingTime=interval)
    box["q"] = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    return box["q"]


def throttled(df: DataFrame, sink: Callable[[DataFrame, int], Any], interval: str) -> StreamingQuery:
    """One micro-batch for each interval; rows are unchanged."""
    return df.writeStream.foreachBatch(sink).trigger(processingTime=interval).start()


def read_files(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A file stream; files_per_trigger is its back-pressure."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(kind).load(path)


def bounded(rows: DataFrame, capacity: int, keys, full: str = "wait") -> DataFrame:
    """A micro-batch held to capacity: "wait" keeps all (the source slows down), "drop_newest" the first, "drop_oldest" the last rows by keys."""
    capacity = max(capacity, 1)
    if full == "wait":
        return rows
    order = [F.col(k).desc() if full == "drop_oldest" else F.col(k) for k in keys]
    return rows.orderBy(*order).limit(capacity)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drives a stream over all that is there now, into a table in memory; for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
    return df.sparkSession.table(name)


def case_sinks(df: DataFrame, *sinks: Callable[[DataFrame], Any] | None, checkpoint: str | None = None) -> StreamingQuery:
    """Each category of a stream with cases to its own sink."""
    from sluice.operators.cases import for_each_case

    writer = df.writeStream.foreachBatch(lambda rows, _: for_each_case(rows, *sinks) and None)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def windowed_counts(df: DataFrame, time: str, late: str, size: str, *keys: str) -> DataFrame:
    """Extension: tumbling windows with a watermark."""
    return df.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))
