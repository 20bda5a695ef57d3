"""YAML records: elements of root sequences, or whole documents, after a filter over parser events."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sluice.sources.errors import ReadOptions, Result
from sluice.sources.files import JsonOptions, contents, json_of, renamer


@dataclass
class YamlOptions(ReadOptions):
    schema: T.StructType | None = None
    allow_aliases: bool = False
    allow_custom_tags: bool = False
    max_depth: int = 64
    max_scalar_length: int | None = None
    max_documents: int | None = None
    max_elements: int | None = None


class Unsafe(ValueError):
    """YamlSecurityError."""


def checked(loader, o: YamlOptions) -> Iterator:
    """Parser events, each looked at before anything is built from it."""
    import yaml

    depth = documents = 0
    while loader.check_event():
        e = loader.get_event()
        if isinstance(e, yaml.DocumentStartEvent):
            documents += 1
            if o.max_documents is not None and documents > o.max_documents:
                raise Unsafe(f"more than {o.max_documents} documents")
        if not o.allow_aliases and (isinstance(e, yaml.AliasEvent) or getattr(e, "anchor", None)):
            raise Unsafe("anchors and aliases are not allowed")
        tag = getattr(e, "tag", None)
        if not o.allow_custom_tags and tag and tag != "!" and not tag.startswith("tag:yaml.org,2002:"):
            raise Unsafe(f"custom tag {tag}")
        if tag and tag.startswith("tag:yaml.org,2002:python"):
            raise Unsafe(f"tag {tag}")
        if isinstance(e, (yaml.SequenceStartEvent, yaml.MappingStartEvent)):
            depth += 1
            if depth > o.max_depth:
                raise Unsafe(f"deeper than {o.max_depth}")
        elif isinstance(e, (yaml.SequenceEndEvent, yaml.MappingEndEvent)):
            depth -= 1
        elif isinstance(e, yaml.ScalarEvent) and o.max_scalar_length is not None and len(e.value) > o.max_scalar_length:
            raise Unsafe(f"a scalar longer than {o.max_scalar_length}")
        yield e


def items(text: str, o: YamlOptions) -> Iterator[tuple[object, tuple[str, str] | None]]:
    """(value, fault) of each record. A document is dropped after its first fault; the rest of the stream can't be trusted then."""
    import yaml

    base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    n = 0
    try:
        # The filter reads the events once, the loader builds values from the same text.
        for _ in checked(base(text), o):
            pass
        for document in yaml.load_all(text, base):
            for value in document if isinstance(document, list) else [document]:
                n += 1
                if o.max_elements is not None and n > o.max_elements:
                    raise Unsafe(f"more than {o.max_elements} elements")
                if value is not None:
                    yield value, None
    except Unsafe as e:
        yield None, ("YamlSecurityError", str(e))
    except yaml.YAMLError as e:
        yield None, ("YamlException", str(e).replace("\n", " "))


def rows_of(files: DataFrame, o: YamlOptions) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_file", "_record", "_line", "_raw", "_value", "_kind", "_message"]
        rename = renamer(o.schema) or (lambda v: v)
        for batch in batches:
            for name, content in zip(batch["_file"], batch["content"], strict=True):
                rows = []
                for k, (value, fault) in enumerate(items(content.decode("utf-8-sig"), o), 1):
                    text = None if fault else json.dumps(rename(value), ensure_ascii=False, default=str)
                    rows.append((name, k, None, text or "", text, *(fault or (None, None))))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, "_file string, _record long, _line long, _raw string, _value string, _kind string, _message string")


def yaml_documents(spark: SparkSession, path: str | Sequence[str], options: YamlOptions) -> Result:
    """Files are records of their root sequences, or of their documents. Unknown properties are ignored; a value that isn't allowed is an error by policy."""
    return bound(rows_of(contents(spark, path), options), options)


def yaml_text(spark: SparkSession, content: str, options: YamlOptions) -> Result:
    files = spark.createDataFrame([("text", bytearray(content.encode()))], "_file string, content binary")
    return bound(rows_of(files, options), options)


def bound(raw: DataFrame, o: YamlOptions) -> Result:
    shared = JsonOptions(action=o.action, sink=o.sink, on_error=o.on_error, metrics=o.metrics, progress=o.progress, schema=o.schema)
    return json_of(raw, shared, "Yaml")
