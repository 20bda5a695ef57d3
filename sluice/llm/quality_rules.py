"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one long whose bit k is set if rule k fails. A policy is a versioned mask over
those bits, so another policy, or the effect of leaving a rule out, is bitwise
arithmetic over the ledger and never reads a text again.

One pass without any shuffle: all of a document's measures come from array
expressions over its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, words_of


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurement columns; null counts as not failing."""

    name: str
    fails: str


#: Bit k of fail_bits is rule k. Append only: ledgers that are stored keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "100 * n_symbols > 15 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("shouting", "100 * n_upper > 50 * word_chars"),
    Rule("exclaiming", "100 * n_exclaim > 20 * n_words"),
    Rule("too_long", "n_words > 1000000"),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in set(names))


BASE = mask("few_words", "repeated_trigrams")
#: version -> the rules that reject under it.
POLICIES = {
    "base": BASE,
    "v1": BASE | mask("symbol_heavy", "repeated_lines", "short_words", "long_words", "shouting", "exclaiming"),
    "v2": (1 << len(RULES)) - 1,
}


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_exclaim of each row.

    Null and empty texts have zeros throughout. Three-word windows are compared
    by 64-bit hashes of their words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(*keep, t.alias("_t"), words_of(F.col(text), f"{SPACE}+").alias("_w"))
    second = first.select(
        *keep,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        without("_t", "[#*$%&|<>]").alias("n_symbols"),
        without("_t", "[A-Z]").alias("n_upper"),
        without("_t", "!").alias("n_exclaim"),
        F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_upper", "n_exclaim"]
    third = second.select(
        *keep,
        *counts,
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2)))").alias("_h"),
    )
    lines = ["n_lines", "n_dup_lines"]
    # Only texts in which some window comes twice are sorted.
    fourth = third.select(
        *keep, *counts, *lines,
        F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h, i AS p))) END").alias("_s"),
    )
    fifth = fourth.select(
        *keep, *counts, *lines,
        F.expr("sort_array(transform(filter(_s, (x, i) -> x.h <=> get(_s, i - 1).h OR x.h <=> get(_s, i + 1).h), x -> x.p))").alias("_p"),
    )
    covered = "aggregate(_p, named_struct('last', -3, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)"
    return fifth.select(*keep, *counts, *lines, F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def without(text: str, pattern: str) -> Column:
    """How many characters of the class stand in the text."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements and fail_bits (long). Rows keep their number; repeated ids are separate rows."""
    bits = [F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long") for rule in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured(docs, text, keep).withColumn("fail_bits", total)


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Adds base_failed, policy and kept: no rule of the base policy and none of the named one fails."""
    bits = F.col("fail_bits")
    return (
        rows.withColumn("base_failed", bits.bitwiseAND(F.lit(BASE)) != 0)
        .withColumn("policy", F.lit(version))
        .withColumn("kept", bits.bitwiseAND(F.lit(POLICIES[version] | BASE)) == 0)
    )


def ablations(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that come back if it alone is left out.

    One aggregation over the ledger; each row of the result is a rule.
    """
    of = POLICIES[version]
    bits = F.col("fail_bits").bitwiseAND(F.lit(of))
    named = [(name, bit) for name, bit in BIT.items() if bit & of]
    summed = rows.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(bits == 0).alias("n_kept"),
        *[F.count_if(bits.bitwiseAND(F.lit(bit)) != 0).alias(f"f_{name}") for name, bit in named],
        *[F.count_if(bits == F.lit(bit)).alias(f"o_{name}") for name, bit in named],
    )
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only_this")) for n, _ in named])
    return summed.select(F.lit(version).alias("policy"), "n_docs", "n_kept", F.inline(each))
