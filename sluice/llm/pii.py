"""Personal data and secrets: patterns propose spans, validators confirm them, nearby words adjust the score.

All of it is array expressions over a document's own row, so a pass has no
shuffle. The patterns of the base kinds are those of the contract, written with
possessive quantifiers and look-behinds so that a text costs time in proportion
to its length, whatever it holds: a match can only start where a run starts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """pattern proposes; valid (SQL over x.v, the match, and x.around, the characters beside it) confirms.

    weight is the score of a confirmed span, context adds to it if one of its words
    stands within NEAR characters; a span stays if its score reaches least.
    """

    name: str
    pattern: str
    gate: str
    valid: str
    weight: float
    context: str
    least: float = 0.0


#: How far context words may stand from a span, in characters, and what they add.
NEAR, GAIN = 40, 0.3
DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
#: Luhn: from the right, every second digit is doubled, less 9 above 9; the sum divides by 10.
LUHN = (
    "aggregate(transform(split(reverse({d}), ''), (c, i) -> CASE WHEN c = '' THEN 0 WHEN i % 2 = 0 THEN int(c) "
    "WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END), 0, (a, d) -> a + d) % 10 = 0"
).replace("{d}", DIGITS)
#: ISO 7064 mod 97: the first four characters go to the end, letters count from 10, the number leaves 1.
MOD97 = (
    "aggregate(filter(split(concat(substr(x.v, 5), substr(x.v, 1, 4)), ''), c -> c <> ''), 0, (a, c) -> "
    "CASE WHEN ascii(c) >= 65 THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + int(c)) % 97 END) = 1"
)
OCTET = "0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Bits a character by the string's own frequencies: random hexadecimal digits have about 3.7, words and runs less.
ENTROPY = (
    "aggregate(array_distinct(filter(split(x.v, ''), c -> c <> '')), 0D, (a, c) -> "
    "a - (length(x.v) - length(replace(x.v, c, ''))) / length(x.v) * log2((length(x.v) - length(replace(x.v, c, ''))) / length(x.v)))"
)
LEAST_BITS = 3.0
#: Words that stand before secrets, alone or at the end of a name.
SECRETS = r"\w{0,30}(?:token|secret|passw|passphrase|api_?key|access_?key|private_?key|credential|bearer|auth)"
#: Public formats of keys that say what they are (fixed values).
PREFIXED = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(_t, '@')", "true", 0.7, "e-?mail|mail|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "contains(_t, '.')", rf"x.v RLIKE r'^{OCTET}(\.{OCTET}){{3}}$'", 0.6, "ip|host|server|address|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", "true", LUHN, 0.7, "card|visa|credit|debit|payment|expir"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(_t, '+')", f"length({DIGITS}) BETWEEN 8 AND 15", 0.6, "tel|phone|call|mobile|fax|whatsapp"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", "true", f"NOT x.around RLIKE '[A-Za-z0-9]' AND {MOD97}", 0.7, "iban|bank|account|konto|transfer", 0.5),
    Kind("key", PREFIXED, "contains(_t, '_') OR contains(_t, 'KIA') OR contains(_t, 'SIA') OR contains(_t, 'xox') OR contains(_t, 'PRIVATE KEY')", "true", 0.8, SECRETS, 0.5),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", "true", f"x.v RLIKE '[0-9]' AND x.v RLIKE '[A-Za-z]' AND {ENTROPY} >= {LEAST_BITS}D", 0.3, SECRETS, 0.5),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "contains(_t, '-')", "NOT x.around RLIKE '[0-9A-Za-z-]' AND NOT x.v RLIKE '^(000|666|9)|-00-|-0000$'", 0.3, "ssn|social security|taxpayer", 0.5),
)
BASE = ("email", "ip", "card", "phone")


def sql_text(value: str) -> str:
    return "r'" + value.replace("'", r"\x27") + "'"


def spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and _spans: array<struct<kind, start, end, score>>, by kind as listed, then start; code points, end exclusive.

    Null and empty texts have no spans. Spans of different kinds may overlap.
    """
    at = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    found = at.select(
        "*", *[F.expr(f"CASE WHEN {k.gate} THEN regexp_extract_all(_t, {sql_text(k.pattern)}, 0) END").alias(f"_m_{k.name}") for k in KINDS]
    )
    # The pieces between the matches give their places.
    split = found.select("*", *[F.expr(f"CASE WHEN size(_m_{k.name}) > 0 THEN split(_t, {sql_text(k.pattern)}, -1) END").alias(f"_p_{k.name}") for k in KINDS])
    sums = split.select("*", *[F.expr(f"transform(_m_{k.name}, (v, i) -> length(v) + length(_p_{k.name}[i]))").alias(f"_n_{k.name}") for k in KINDS])
    blocks = sums.select(
        "*",
        *[
            F.expr(
                f"CASE WHEN size(_m_{k.name}) > 0 THEN transform(sequence(0, (size(_m_{k.name}) - 1) div {BLOCK}), b -> "
                f"aggregate(slice(_n_{k.name}, int(b) * {BLOCK} + 1, {BLOCK}), 0L, (a, x) -> a + x)) END"
            ).alias(f"_b_{k.name}")
            for k in KINDS
        ],
    )
    placed = blocks.select(*keep, F.concat(*[F.coalesce(F.expr(of_kind(k)), F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)")) for k in KINDS]).alias("_spans"))
    return placed


def of_kind(k: Kind) -> str:
    """SQL for the confirmed spans of one kind; before every block of matches stands the sum of the earlier blocks, so many matches stay cheap."""
    n = k.name
    start = (
        f"(aggregate(slice(_b_{n}, 1, int(i div {BLOCK})), 0L, (a, x) -> a + x) "
        f"+ aggregate(slice(_n_{n}, int(i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK}), 0L, (a, x) -> a + x) + length(_p_{n}[i]))"
    )
    placed = f"transform(_m_{n}, (v, i) -> named_struct('v', v, 's', {start}))"
    around = f"transform({placed}, x -> named_struct('v', x.v, 's', x.s, 'around', concat(CASE WHEN x.s > 0 THEN substr(_t, int(x.s), 1) ELSE '' END, substr(_t, int(x.s) + length(x.v) + 1, 1))))"
    valid = f"filter({around}, x -> {k.valid})"
    near = f"substr(_t, greatest(int(x.s) + 1 - {NEAR}, 1), length(x.v) + {NEAR} + least({NEAR}, int(x.s)))"
    score = f"least(1.0D, {k.weight}D + CASE WHEN lower({near}) RLIKE {sql_text(chr(92) + 'b(?:' + k.context + ')')} THEN {GAIN}D ELSE 0D END)"
    scored = f"transform({valid}, x -> named_struct('kind', '{n}', 'start', x.s, 'end', x.s + length(x.v), 'score', {score}))"
    return f"filter({scored}, x -> x.score >= {k.least}D)"


def joined(where: str = "true") -> F.Column:
    return F.expr(f"array_join(transform(filter(_spans, x -> {where}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: keep, counts of the base kinds, base_sha256, spans (text), counts of the added kinds (n_iban, n_key, n_secret, n_ssn), n_spans and has_pii."""
    base = "x.kind IN ({})".format(", ".join(f"'{b}'" for b in BASE))
    return spans(docs, text, keep).select(
        *keep,
        *[F.expr(f"cast(size(filter(_spans, x -> x.kind = '{k.name}')) as bigint)").alias(f"n_{k.name}") for k in KINDS if k.name in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined().alias("spans"),
        *[F.expr(f"cast(size(filter(_spans, x -> x.kind = '{k.name}')) as bigint)").alias(f"n_{k.name}") for k in KINDS if k.name not in BASE],
        F.size("_spans").cast("long").alias("n_spans"),
        (F.size("_spans") > 0).alias("has_pii"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by <KIND>; of overlapping spans the first wins. Null stays null."""
    # Spans and the row travel together, in one pass.
    found = spans(docs.select(F.struct("*").alias("_own"), F.col(text).alias("_text")), "_text", ("_own",))
    order = "array_sort(transform(_spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"
    parts = (
        f"aggregate({order}, named_struct('at', 0L, 'out', ''), (a, x) -> CASE WHEN x.start < a.at THEN a ELSE named_struct('at', x.end, 'out', "
        f"concat(a.out, substr(_own.`{text}`, int(a.at) + 1, int(x.start - a.at)), '<', upper(x.kind), '>')) END, a -> concat(a.out, substr(_own.`{text}`, int(a.at) + 1)))"
    )
    done = found.withColumn("_new", F.expr(parts))
    return done.select(*[F.col("_new").alias(c) if c == text else F.col(f"_own.`{c}`").alias(c) for c in docs.columns])
