"""Upserts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(target: DataFrame, updates: DataFrame, key: str | Sequence[str], only: Sequence[str] | None = None, insert: bool = True) -> DataFrame:
    """target with updates applied by key: one full join. only names the columns that matched rows take; others keep theirs.

    Keys must be unique among the updates; null values in them overwrite.
    """
    keys = [key] if isinstance(key, str) else list(key)
    u = updates.withColumn("_hit", F.lit(True)).alias("u")
    on = None
    for k in keys:
        test = F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}"))
        on = test if on is None else on & test
    both = target.withColumn("_old", F.lit(True)).alias("t").join(u, on, "full" if insert else "left")
    out = []
    for c in target.columns:
        old, new = F.col(f"t.{c}"), F.col(f"u.{c}") if c in updates.columns else F.lit(None).cast(target.schema[c].dataType)
        if c in keys:
            out.append(F.coalesce(old, new).alias(c))
        elif c not in updates.columns or (only is not None and c not in only):
            out.append(F.when(F.col("t._old"), old).otherwise(new).alias(c))
        else:
            out.append(F.when(F.col("u._hit"), new).otherwise(old).alias(c))
    return both.select(*out)


def merge_table(spark: SparkSession, name: str, updates: DataFrame, key: str | Sequence[str], only: Sequence[str] | None = None) -> None:
    """Upsert into a catalog table: a new version of it, written whole, takes the table's place."""
    keys = [key] if isinstance(key, str) else list(key)
    if not spark.catalog.tableExists(name):
        updates.write.saveAsTable(name)
        return
    target = spark.table(name)
    version = f"{name}_{uuid.uuid4().hex[:8]}"
    # Readers see the old table until the new one is whole.
    upserted(target, updates, keys, only).write.saveAsTable(version)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {version} RENAME TO {name}")


def write_table(df: DataFrame, name: str, create_if_missing: bool = True, overwrite: bool = False, partition_by: Sequence[str] = ()) -> None:
    if not create_if_missing and not df.sparkSession.catalog.tableExists(name):
        raise LookupError(f"no table {name}")
    df.write.mode("overwrite" if overwrite else "append").partitionBy(*partition_by).saveAsTable(name)
