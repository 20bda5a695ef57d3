"""Looking at frames without changing them."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

log = logging.getLogger("sluice")


def spy(df: DataFrame, tag: str, n: int = 20, show: Callable[[Row], str] | None = None, out: Callable[[str], object] = print) -> DataFrame:
    """Prints the first rows under the tag and hands df on."""
    out(f"--- {tag} ---")
    for row in df.take(n):
        out(show(row) if show else ", ".join(f"{k}={v}" for k, v in row.asDict().items()))
    return df


def display(df: DataFrame, tag: str = "Displaying", n: int = 20, out: Callable[[str], object] = print) -> None:
    """Prints numbered rows."""
    out(f"--- {tag} ---")
    for k, row in enumerate(df.take(n)):
        out(f"{k}: " + ", ".join(f"{c}={v}" for c, v in row.asDict().items()))


def log_spy(df: DataFrame, tag: str, n: int = 20, level: int = logging.INFO) -> DataFrame:
    return spy(df, tag, n, out=lambda line: log.log(level, line))


def counters(df: DataFrame, **columns: Column):
    """(df, Observation) whose values are ready after the next action, without a pass of their own."""
    from pyspark.sql import Observation

    seen = Observation()
    return df.observe(seen, *[c.alias(k) for k, c in (columns or {"n": F.count(F.lit(1))}).items()]), seen


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def schema_text(df: DataFrame) -> str:
    return df.schema.treeString()
