"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as one class of a regular expression.
SPACE = r"[\x20\x09-\x0D]"
#: What separates the words of the benchmark contract once A-Z is lower-cased.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else untouched; the fast built-in serves texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, separator: str) -> Column:
    """The non-empty pieces between separators; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator, -1), "")


#: Stands for a null id where ids travel as numbers.
NO_ID = -(1 << 63)


def id_or_none(column: str | Column) -> Column:
    """The id, null again where it stood for none."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != NO_ID, c)


def held_out(doc_id: Column) -> Column:
    """The rows that no label may be learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one where that is unset (local runs)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/sluice/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read back: it is computed once, its lineage is cut, and lost executors cost nothing that is done."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Batches of so many rows at most to Python workers, for what runs inside: a batch of whole texts is large, in the JVM and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that stored() wrote and that no later step reads."""
    for t in tables:
        if t is not None and (path := t.__dict__.pop("stored_at", None)):
            drop_folder(t.sparkSession, path)


def clean_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps that are done: it does so once the driver's JVM finds that nothing refers to them."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


#: Tables are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, size: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if the bytes that the SQL expression counts for each row stay within bounds; else Spark joins by shuffle."""
    n = df.agg(F.coalesce(F.sum(F.expr(size)), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if n <= most else df


def give_back() -> None:
    """Returns memory that a task has freed to the system: workers live on, idle or in other tasks, beside the executor's heap."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no such allocator here
        pass


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems, whatever its scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, for executors that write or read raw files. A bare path is local or mounted."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, parts) -> None:
    """Write byte strings to a new file. The name appears at the end, by a rename, so a task that is run again or twice leaves one whole file."""
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    try:
        fs.move(draft, path)
    except OSError:
        # Some file systems refuse a name that is taken: an earlier run of the task has written the whole file.
        if fs.get_file_info(path).type.name != "File":
            raise
        fs.delete_file(draft)


def get_range(uri: str, start: int, length: int) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(length, start)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, str, int]]:
    """(doc_id, whole text, label) of at most bound labelled rows that labels may be learned from, chosen by a hash of the id, in its order."""
    some = labels.filter(~held_out(F.col(doc_id)) & F.col(label).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    some = some.orderBy(F.xxhash64("_id"), "_id", "_y").limit(bound)
    found = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(some), "_id")
    return sorted(((r["_id"], r["_t"], r["_y"]) for r in found.toLocalIterator()), key=lambda r: (r[0], r[2]))


def logistic(x, y, ridge: float = 1e-2, steps: int = 40):
    """(weights, bias, means, scales) of a logistic regression by Newton's method on standardised features."""
    import numpy as np

    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * len(x) * 1e-2 * np.eye(z.shape[1])
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * len(x) * 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1]), mean, scale
