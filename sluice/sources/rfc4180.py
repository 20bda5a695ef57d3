"""CSV records by RFC 4180, from any text in pieces, with the faults that a record has."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from enum import Enum


class QuoteMode(Enum):
    """STRICT: a quote inside an unquoted field is text. LENIENT: it opens a quoted part. ERROR: it is a fault."""

    STRICT = "strict"
    LENIENT = "lenient"
    ERROR = "error"


@dataclass(frozen=True)
class Dialect:
    separator: str = ","
    quote_mode: QuoteMode = QuoteMode.STRICT
    trailing_garbage_is_error: bool = False
    trim: bool = False
    normalize_newlines: bool = False
    max_columns: int | None = None
    max_record_length: int | None = None


@dataclass
class Record:
    """number and line count from 1; fault: (type, message) or None."""

    number: int
    line: int
    fields: list[str]
    raw: str
    fault: tuple[str, str] | None


def records(pieces: Iterable[str], dialect: Dialect = Dialect()) -> Iterator[Record]:
    """Blank lines are no records. A quote that never closes ends its record at the end of the text, as a fault."""
    sep = dialect.separator[:1] or ","
    number, line, start = 0, 1, 1
    fields: list[str] = []
    field: list[str] = []
    raw: list[str] = []
    state, fault = "start", None  # start of a field, plain, quoted, closed (after a closing quote)
    held_cr = False

    def note(kind: str, message: str) -> None:
        nonlocal fault
        fault = fault or (kind, message)

    def end_field() -> None:
        nonlocal state
        text = "".join(field)
        if dialect.trim:
            text = text.strip()
        if dialect.normalize_newlines:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        fields.append(text)
        field.clear()
        state = "start"
        if dialect.max_columns is not None and len(fields) > dialect.max_columns:
            note("CsvLimitExceeded", f"more than {dialect.max_columns} columns")

    def end_record() -> Record | None:
        nonlocal number, fault, start
        if not fields and not field and state == "start":
            raw.clear()
            start = line
            return None
        end_field()
        number += 1
        text = "".join(raw)
        if dialect.max_record_length is not None and len(text) > dialect.max_record_length:
            note("CsvLimitExceeded", f"longer than {dialect.max_record_length} characters")
        out = Record(number, start, fields[:], text, fault)
        fields.clear()
        raw.clear()
        fault, start = None, line
        return out

    mark = re.compile('[\r\n"]')
    run = re.compile(f'[^{re.escape(sep)}\r\n"]+')
    for piece in pieces:
        i = 0
        while i < len(piece):
            if held_cr:
                held_cr = False
                if piece[i] == "\n":
                    i += 1  # the second half of an end of line that counted already
                    continue
            if state == "start" and not raw:
                # A whole line without a quote is cut at its separators.
                m = mark.search(piece, i)
                if m is not None and m[0] != '"':
                    text, at = piece[i : m.start()], line
                    line += 1
                    start, held_cr, i = line, m[0] == "\r", m.end()
                    if text:
                        cells = text.split(sep)
                        if dialect.max_columns is not None and len(cells) > dialect.max_columns:
                            note("CsvLimitExceeded", f"more than {dialect.max_columns} columns")
                        elif dialect.max_record_length is not None and len(text) > dialect.max_record_length:
                            note("CsvLimitExceeded", f"longer than {dialect.max_record_length} characters")
                        number += 1
                        yield Record(number, at, [c.strip() for c in cells] if dialect.trim else cells, text, fault)
                        fault = None
                    continue
            m = run.match(piece, i)
            c = piece[i] if m is None else m[0]
            i += len(c)
            if state == "quoted":
                raw.append(c)
                if c == "\n":
                    line += 1
                if c == '"':
                    state = "closed"
                else:
                    field.append(c)
                continue
            if c in ("\r", "\n"):
                line += 1
                held_cr = c == "\r"
                if (r := end_record()) is not None:
                    yield r
                continue
            raw.append(c)
            if c == sep:
                end_field()
                continue
            if c == '"':
                if state == "start":
                    state = "quoted"
                elif state == "closed":
                    field.append(c)
                    state = "quoted"
                elif dialect.quote_mode is QuoteMode.LENIENT:
                    state = "quoted"
                else:
                    if dialect.quote_mode is QuoteMode.ERROR:
                        note("CsvQuoteError", "a quote inside an unquoted field")
                    field.append(c)
                continue
            if state == "closed":
                if not dialect.trailing_garbage_is_error:
                    c = c.lstrip(" \t")
                    if not c:
                        continue
                if dialect.trailing_garbage_is_error or dialect.quote_mode is QuoteMode.ERROR:
                    note("CsvQuoteError", "text after a closing quote")
            field.append(c)
            state = "plain"
    if state == "quoted":
        note("CsvQuoteError", "a quote that never closes")
    if (r := end_record()) is not None:
        yield r
