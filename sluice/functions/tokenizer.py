"""Regular-expression tokens of lines, and builders of patterns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed names of what no pattern matched, and of the end of a line.
UNMATCHED_LINE, UNMATCHED_SLICE, EOF = "%UnmatchedLine%", "%UnmatchedSlice%", "%EOF%"
TOKENS = "array<struct<group_name:string,subpart:string>>"

CHAR, SPACE, ALPHNUM, NUM, ALPHA = ".", r"\s", r"\w", r"\d", "[a-zA-Z]"
ANY_CHARS, SPACES, MAYBE_SPACES, ALPHNUMS, NUMS, ALPHAS = ".*", r"\s+", r"\s*", r"\w+", r"\d+", "[a-zA-Z]+"
WORD = MAYBE_SPACES + ALPHNUMS + MAYBE_SPACES


def group(pattern: str) -> str:
    """As one unit for a quantifier: wrapped unless it is a single character, escape, class or group already."""
    if len(pattern) == 1 or re.fullmatch(r"\\.|\[[^\[\]]*\]|\([^()]*\)", pattern):
        return pattern
    return f"(?:{pattern})"


def any_of(pattern: str) -> str:
    return group(pattern) + "*"


def many(pattern: str, least: int | None = None, most: int | None = None) -> str:
    return group(pattern) + ("+" if least is None else f"{{{least},{most}}}")


def maybe(pattern: str) -> str:
    return group(pattern) + "?"


def as_(pattern: str, name: str = "") -> str:
    return f"(?P<{name}>{pattern})" if name else f"({pattern})"


def one_of(*choices: str) -> str:
    """A class of single characters, an alternation of longer ones."""
    return "[" + "".join(map(re.escape, choices)) + "]" if all(len(c) == 1 for c in choices) else "|".join(choices)


def in_spaces(pattern: str) -> str:
    return SPACES + pattern + SPACES


def words(n: int) -> str:
    return WORD * n


class Tokenizer:
    """Patterns in order; the first that captures anything in a line cuts it."""

    def __init__(self, *patterns: str | re.Pattern):
        self.patterns = [re.compile(p) for p in patterns]

    def add(self, pattern: str | re.Pattern) -> Tokenizer:
        self.patterns.append(re.compile(pattern))
        return self

    def tokens(self, line: str | None) -> list[tuple[str, str]]:
        """(group, text) of the whole line in order; unnamed groups go by their number. Captures that start together are refused."""
        if line is None:
            return []
        for p in self.patterns:
            names = {k: n for n, k in p.groupindex.items()}
            found = sorted(
                (m.start(k), m.end(k), names.get(k, str(k))) for m in p.finditer(line) for k in range(1, p.groups + 1) if m.start(k) >= 0
            )
            if not found:
                continue
            out, at = [], 0
            for n, (start, end, name) in enumerate(found):
                if n and start == found[n - 1][0]:
                    raise ValueError("two captures start at one place")
                if start > at:
                    out.append((UNMATCHED_SLICE, line[at:start]))
                out.append((name, line[start:end]))
                at = end
            if at < len(line):
                out.append((UNMATCHED_SLICE, line[at:]))
            return out
        return [(UNMATCHED_LINE, line)]

    def tokenize(self, line: Column) -> Column:
        """array<struct<group_name, subpart>>; a null line has none."""
        this = self

        @F.pandas_udf(TOKENS)
        def run(lines: pd.Series) -> pd.Series:
            return lines.map(lambda x: [{"group_name": g, "subpart": s} for g, s in this.tokens(x)] if x is not None else [])

        return run(line)


def tokens_flat(df: DataFrame, tokenizer: Tokenizer, line: str, keep: Sequence[str] = ()) -> DataFrame:
    """keep, index, group_name, subpart: a row for each token, and one for the end of each line."""
    end = F.array(F.struct(F.lit(EOF).alias("group_name"), F.lit("\n").alias("subpart")))
    cut = df.withColumn("_tokens", tokenizer.tokenize(F.col(line)))
    return cut.select(*keep, F.posexplode(F.concat("_tokens", end)).alias("index", "_t")).select(*keep, "index", "_t.group_name", "_t.subpart")


def select_case_by_group(tokens: Column, selectors: dict[str, Callable[[Column], Column]]) -> Column:
    """Tokens with each subpart transformed by its group's selector; a group without one raises."""

    def one(t: Column) -> Column:
        out = F.raise_error(F.concat(F.lit("no selector for group "), t["group_name"])).cast("string")
        for name, f in selectors.items():
            out = F.when(t["group_name"] == name, f(t["subpart"])).otherwise(out)
        return F.struct(t["group_name"].alias("group_name"), out.alias("subpart"))

    return F.transform(tokens, one)


def for_each_case_by_group(flat: DataFrame, actions: dict[str, Callable[[DataFrame], object]]) -> DataFrame:
    """Each action on the rows of its group; returns the tokens."""
    kept = flat.persist()
    try:
        for name, act in actions.items():
            act(kept.filter(F.col("group_name") == name))
    finally:
        kept.unpersist()
    return flat


def rebuilt(tokens: Column, selectors: dict[str, Callable[[Column], Column]]) -> Column:
    """The line again, with some groups transformed."""

    def one(t: Column) -> Column:
        out = t["subpart"]
        for name, f in selectors.items():
            out = F.when(t["group_name"] == name, f(t["subpart"])).otherwise(out)
        return out

    return F.array_join(F.transform(tokens, one), "")


def extracted(line: Column, pattern: str, group_no: int = 1) -> Column:
    """All captures of one group without the gaps: stays in the JVM."""
    return F.regexp_extract_all(line, F.lit(pattern), group_no)
