"""Opaque Python functions as vectorised columns; built-in expressions are to be preferred."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def vectorised(f: Callable, returns: str) -> Callable[..., Column]:
    """A function of one to ten values as a function of as many columns, in Arrow batches."""

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*columns, strict=True)])

    return run


def on_entity(f: Callable, returns: str, columns: Sequence[str] | None = None) -> Column:
    """A function whose parameters are named as columns of the frame."""
    names = list(columns or inspect.signature(f).parameters)
    return vectorised(f, returns)(*[F.col(n) for n in names])


def register(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """For use in SQL."""
    spark.udf.register(name, f, returns)
