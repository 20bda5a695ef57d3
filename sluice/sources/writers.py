"""Sinks: text, CSV, JSON and YAML as Spark folders or as single files."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.sources.errors import Metrics


@dataclass
class WriteOptions:
    encoding: str = "utf-8"
    append: bool = False
    metrics: Metrics | None = None


@dataclass
class CsvWriteOptions(WriteOptions):
    separator: str = ","
    header: bool = True
    newline: str = "\n"


@dataclass
class JsonWriteOptions(WriteOptions):
    indented: bool = True
    lines: bool = False
    parts: bool = False
    """A folder in which each task writes a file with an array of its own, in place of one file."""


@dataclass
class YamlWriteOptions(WriteOptions):
    write_empty: bool = True
    batch_size: int | None = None
    parts: bool = False
    """A folder in which each task writes a file with a sequence of its own, in place of one file."""


def mode(o: WriteOptions) -> str:
    return "append" if o.append else "overwrite"


def counted(df: DataFrame, o: WriteOptions):
    if o.metrics is None:
        return df, lambda: None
    from pyspark.sql import Observation

    seen = Observation()

    def done() -> None:
        o.metrics.emitted, o.metrics.completed = seen.get["n"], time.time()

    return df.observe(seen, F.count(F.lit(1)).alias("n")), done


def text(df: DataFrame, path: str, options: WriteOptions | None = None, value: str = "value") -> None:
    """A folder of text files, a line for each row."""
    o = options or WriteOptions()
    rows, done = counted(df.select(F.col(value).cast("string").alias("value")), o)
    rows.write.mode(mode(o)).text(path)
    done()


def csv(df: DataFrame, path: str, options: CsvWriteOptions | None = None) -> None:
    """A folder of CSV files; values with separators, quotes, line ends or outer blanks are quoted, nulls are empty."""
    o = options or CsvWriteOptions()
    rows, done = counted(df, o)
    rows.select(csv_line(df.columns, o.separator).alias("value")).write.mode(mode(o)).option("lineSep", o.newline).text(path) if not o.header else (
        rows.write.mode(mode(o))
        .options(header=True, sep=o.separator, quote='"', escape='"', emptyValue="", nullValue="", lineSep=o.newline, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding=o.encoding)
        .csv(path)
    )
    done()


def quoted(value: Column, separator: str = ",") -> Column:
    text_ = F.coalesce(value.cast("string"), F.lit(""))
    special = text_.contains(separator) | text_.rlike('["\r\n]') | text_.rlike("^ | $")
    return F.when(special, F.concat(F.lit('"'), F.replace(text_, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text_)


def csv_line(columns: Iterable[str | Column], separator: str = ",") -> Column:
    """A record as one CSV line."""
    return F.concat_ws(separator, *[quoted(F.col(f"`{c}`") if isinstance(c, str) else c, separator) for c in columns])


def csv_header(df: DataFrame, separator: str = ",") -> str:
    plain = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in (separator, '"', "\n", "\r")) else c
    return separator.join(map(plain, df.columns))


def json_(df: DataFrame, path: str, options: JsonWriteOptions | None = None) -> None:
    """NDJSON or files of arrays as a folder, by the tasks; else one file with one array, streamed through the driver a partition at a time."""
    o = options or JsonWriteOptions()
    if o.lines:
        rows, done = counted(df, o)
        rows.write.mode(mode(o)).json(path)
        done()
        return
    if o.parts:
        rows, done = counted(df, o)
        rows.select(as_json(rows)).mapInPandas(json_array, "value string").write.mode(mode(o)).text(path)
        done()
        return
    n = 0
    with open_file(path, o) as f:
        f.write("[")
        for (row,) in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
            value = json.dumps(json.loads(row), ensure_ascii=False, indent=2 if o.indented else None)
            f.write((",\n" if n else "\n") + value if o.indented else ("," if n else "") + value)
            n += 1
        f.write("\n]\n" if o.indented and n else "]\n")
    finish(o, n)


def as_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")


def json_array(batches):
    """A task's values as the lines of one array."""
    n = 0
    for batch in batches:
        lines = batch["value"].copy()
        for k in range(len(lines)):
            lines.iat[k] = ("," if n else "[") + lines.iat[k]
            n += 1
        yield pd.DataFrame({"value": lines})
    yield pd.DataFrame({"value": ["]" if n else "[]"]})


def yaml_(df: DataFrame, path: str, options: YamlWriteOptions | None = None) -> None:
    """One file with a sequence item for each row, or with batch_size a document for each batch; parts: a folder of files, by the tasks, an item a line."""
    import yaml

    o, n, held = options or YamlWriteOptions(), 0, []
    if o.parts:
        rows, done = counted(df, o)
        # JSON values are YAML values.
        rows.select(F.concat(F.lit("- "), as_json(rows)).alias("value")).write.mode(mode(o)).text(path)
        done()
        return
    with open_file(path, o) as f:

        def flush() -> None:
            if held:
                f.write(("---\n" if o.batch_size and n > len(held) else "") + yaml.safe_dump(held, allow_unicode=True, sort_keys=False))
                held.clear()

        for (row,) in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
            held.append(json.loads(row))
            n += 1
            if len(held) == (o.batch_size or 1):
                flush()
        flush()
        if not n and o.write_empty:
            f.write("[]\n")
    finish(o, n)


def yaml_batched(df: DataFrame, path: str, batch_size: int = 1000) -> None:
    yaml_(df, path, YamlWriteOptions(batch_size=batch_size))


def open_file(path: str, o: WriteOptions):
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return open(path, "a" if o.append else "w", encoding=o.encoding, newline="")


def finish(o: WriteOptions, n: int) -> None:
    if o.metrics is not None:
        o.metrics.emitted, o.metrics.completed = n, time.time()


def write_in_file(lines: Iterable[str], path: str, suffix: str = ".old", flush_each: bool = False) -> None:
    """Lines into a new file; one that is there keeps its content under the suffix."""
    with create_with_backup(path, suffix) as f:
        for line in lines:
            f.write(f"{line}\n")
            if flush_each:
                f.flush()


def create_with_backup(path: str, suffix: str = ".old"):
    """A new file with its folders; an existing one is renamed first, a folder is refused."""
    p = Path(path)
    if p.is_dir():
        raise IsADirectoryError(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    if p.exists():
        p.replace(p.with_name(p.name + suffix))
    return p.open("w", encoding="utf-8")


def derived_name(path: str, derive: Callable[[str], str], keep_extension: bool = True, *parents: Callable[[str], str]) -> str:
    """A path whose name, and names of folders above it from the nearest on, are derived from the old ones."""
    p = Path(path)
    name = derive(p.stem) + p.suffix if keep_extension else derive(p.name)
    above = list(p.parent.parts)
    for k, f in enumerate(parents, 1):
        if k <= len(above):
            above[-k] = f(above[-k])
    return str(Path(*above, name)) if above else name


def parquet(df: DataFrame, path: str, overwrite: bool = True, partition_by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite" if overwrite else "append").partitionBy(*partition_by).parquet(path)


def orc(df: DataFrame, path: str, overwrite: bool = True, partition_by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite" if overwrite else "append").partitionBy(*partition_by).orc(path)


def kafka(df: DataFrame, servers: str, topic: str) -> None:
    """Rows as JSON messages; needs Spark's Kafka connector on the class path."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
