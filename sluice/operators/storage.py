"""Folders for intermediate results that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where that is unset on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sluice/{label}-{uuid.uuid4().hex}"
