"""Sheets of xlsx workbooks, read with the standard library and typed as CSV is."""

from __future__ import annotations

import csv as _csv
import io
import re
import zipfile
from dataclasses import dataclass
from datetime import datetime, timedelta
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import SparkSession

from sluice.sources.errors import Result
from sluice.sources.files import CsvOptions, csv_text

# Namespaces and built-in date formats of the public standard.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


@dataclass
class WorkbookOptions:
    include_hidden: bool = False
    include_empty: bool = False
    folder: str | None = None


@dataclass
class Sheet:
    name: str
    hidden: bool
    rows: list[list[str]]


def column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> list[Sheet]:
    """All sheets in order; cells as text, dates as ISO text, booleans as true and false."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = set(z.namelist())
        xml = lambda name: ElementTree.fromstring(z.read(name))
        strings = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in parts else []
        dates = styles(xml("xl/styles.xml")) if "xl/styles.xml" in parts else []
        links = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels").iter(f"{PACKAGE}Relationship")}
        book, out = xml("xl/workbook.xml"), []
        since = book.find(f"{MAIN}workbookPr")
        epoch = datetime(1904, 1, 1) if since is not None and since.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        for s in book.iter(f"{MAIN}sheet"):
            target = links[s.get(f"{LINKS}id")].lstrip("/")
            rows: list[list[str]] = []
            for r in xml(target if target.startswith("xl/") else f"xl/{target}").iter(f"{MAIN}row"):
                at = int(r.get("r", len(rows) + 1)) - 1
                rows += [[] for _ in range(at + 1 - len(rows))]
                for c in r.iter(f"{MAIN}c"):
                    k = column(c.get("r")) if c.get("r") else len(rows[at])
                    rows[at] += [""] * (k + 1 - len(rows[at]))
                    rows[at][k] = cell(c, strings, dates, epoch)
            out.append(Sheet(s.get("name"), s.get("state", "visible") != "visible", rows))
        return out


def styles(root) -> list[bool]:
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    formats = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in (formats if formats is not None else [])]
    return [i in DATE_FORMATS or bool(re.search("[dmyhs]", plain(own.get(i, "")), re.I)) for i in ids]


def cell(c, strings: list[str], dates: list[bool], epoch: datetime) -> str:
    kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
    text = v.text if v is not None and v.text is not None else ""
    if kind == "s":
        return strings[int(text)] if text else ""
    if kind == "b":
        return "true" if text == "1" else "false"
    style = int(c.get("s", 0))
    if kind == "n" and text and style < len(dates) and dates[style]:
        return (epoch + timedelta(seconds=round(float(text) * 86400))).isoformat(sep=" ")
    return text


def as_csv(sheet: Sheet) -> str:
    out, width = io.StringIO(), max(map(len, sheet.rows), default=0)
    writer = _csv.writer(out, lineterminator="\n")
    for r in sheet.rows:
        if any(r):
            writer.writerow(r + [""] * (width - len(r)))
    return out.getvalue()


def content_of(spark: SparkSession, path: str) -> bytes:
    """The workbook through Spark's readers; workbooks are small by their format's limits."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def to_csv(spark: SparkSession, path: str, options: WorkbookOptions | None = None) -> list[str]:
    """Each visible, non-empty sheet as a CSV file in a folder; files of a failed conversion are removed."""
    import tempfile

    o, made = options or WorkbookOptions(), []
    if o.folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, name a folder that all executors share")
    folder = Path(o.folder or tempfile.mkdtemp(prefix="sheets-"))
    folder.mkdir(parents=True, exist_ok=True)
    try:
        for s in sheets(content_of(spark, path)):
            if (s.hidden and not o.include_hidden) or (not any(map(any, s.rows)) and not o.include_empty):
                continue
            made.append(folder / (re.sub(r"[^\w.-]", "_", s.name) + ".csv"))
            made[-1].write_text(as_csv(s), encoding="utf-8")
    except Exception:
        for f in made:
            f.unlink(missing_ok=True)
        raise
    return [str(f) for f in made]


def sheet(spark: SparkSession, path: str, which: str | int = 0, options: CsvOptions | None = None) -> Result:
    """A sheet by name or by its place among the visible ones, through the CSV rules. An unknown sheet raises."""
    found = [s for s in sheets(content_of(spark, path)) if not s.hidden]
    if isinstance(which, str):
        one = next((s for s in found if s.name == which), None)
    else:
        one = found[which] if 0 <= which < len(found) else None
    if one is None:
        raise LookupError(f"no sheet {which!r}")
    return csv_text(spark, as_csv(one), options)
