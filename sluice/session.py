"""Sessions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession


def connect(master: str | None = None, app: str = "sluice", options: dict[str, str] | None = None, hive: bool = False) -> SparkSession:
    """A session in UTC and ANSI mode with adaptive execution. Without master, the one of spark-submit or of the cluster holds."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in (settings | (options or {})).items():
        builder = builder.config(key, value)
    return (builder.enableHiveSupport() if hive else builder).getOrCreate()


def push(spark: SparkSession, rows, schema, batch_size: int = 10_000) -> DataFrame:
    """Local rows as a DataFrame; batch_size rows travel in one slice."""
    rows = list(rows)
    df = spark.createDataFrame(rows, schema)
    return df.repartition(max(1, -(-len(rows) // batch_size))) if len(rows) > batch_size else df


def pull(df: DataFrame) -> Iterator[Row]:
    """Rows as a stream on the driver, a partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


def ship(spark: SparkSession, *files: str) -> None:
    """Python files or archives for the workers."""
    for f in files:
        spark.sparkContext.addPyFile(f)
