"""The operators as queries over their whole tables, with production parameters, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, line_dedup, minhash, packing, pii, quality_cnn, quality_rules, token_output, toxicity, warc
from sluice.llm.common import stored, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, and would alone: from the stored ledger, whose texts are not read again."""
    rows = stored(quality_rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    return quality_rules.ablations(rows, "v1")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read(token_output.write(table(spark, sf_dir, "documents"), end=1))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), end=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs, F.col("source")).select("doc_id", "n_lines", "n_dropped", "text")


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_output": op4_token_output,
    "op5_pii": op5_pii,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_minhash": op9_minhash,
    "op10_line_dedup": op10_line_dedup,
    "quality_rule_ablations": quality_rule_ablations,
}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT cast(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, n, list_slice(w, s, s + n - 1) AS win
  FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s)
),
dw AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS win
  FROM (SELECT doc_id, w, n FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s)
),
hit AS (SELECT doc_id, s, n, item FROM dw JOIN win USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
rep AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS c FROM tri),
cover AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    cast(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    cast(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaim,
    cast(len(l) AS BIGINT) AS n_lines, cast(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, cast(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cover USING (doc_id)
),
b AS (
  SELECT *, cast((n_words < 50) AS BIGINT) + 2 * cast((100 * n_repeat_words > 50 * n_words) AS BIGINT) + 4 * cast((100 * n_symbols > 15 * n_words) AS BIGINT)
    + 8 * cast((100 * n_dup_lines > 30 * n_lines) AS BIGINT) + 16 * cast((word_chars < 2 * n_words) AS BIGINT) + 32 * cast((word_chars > 20 * n_words) AS BIGINT)
    + 64 * cast((100 * n_upper > 50 * word_chars) AS BIGINT) + 128 * cast((100 * n_exclaim > 20 * n_words) AS BIGINT) + 256 * cast((n_words > 1000000) AS BIGINT) AS fail_bits
  FROM m
)
"""
OP3_SQL = f"""{LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 255) = 0 AS kept, fail_bits FROM b
"""
ABLATIONS_SQL = f"""{LEDGER_SQL}
SELECT 'v1' AS policy, (SELECT count(*) FROM b) AS n_docs, (SELECT count(*) FROM b WHERE fail_bits & 255 = 0) AS n_kept, rule,
  (SELECT count(*) FROM b WHERE fail_bits & bit <> 0) AS n_failed, (SELECT count(*) FROM b WHERE fail_bits & 255 = bit) AS n_only_this
FROM (VALUES {", ".join(f"('{r.name}', {1 << k})" for k, r in enumerate(quality_rules.RULES[:8]))}) AS rules(rule, bit)
"""


def _pii_sql() -> str:
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = (
        f"length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN cast(substr(reverse({digits}), i, 1) AS INT) "
        f"WHEN cast(substr(reverse({digits}), i, 1) AS INT) > 4 THEN 2 * cast(substr(reverse({digits}), i, 1) AS INT) - 9 ELSE 2 * cast(substr(reverse({digits}), i, 1) AS INT) END)) % 10 = 0"
    )
    octets = "list_bool_and(list_transform(string_split(v, '.'), lambda o: regexp_matches(o, '^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')))"
    mod97 = (
        "list_reduce(list_prepend(0, list_transform(string_split(substr(v, 5) || substr(v, 1, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE cast(c AS INT) END)), "
        "lambda a, x: (a * (CASE WHEN x >= 10 THEN 100 ELSE 10 END) + x) % 97) = 1"
    )
    beside = "(CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END || substr(t, s + length(v) + 1, 1))"
    near = "lower(substr(t, greatest(s + 1 - 40, 1), length(v) + 40 + least(40, s)))"
    p = "((length(v) - length(replace(v, c, ''))) / length(v))"
    entropy = f"list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -{p} * log2({p})))"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", octets),
        "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
        "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", f"NOT regexp_matches({beside}, '[A-Za-z0-9]') AND {mod97}"),
        "key": (pii.PREFIXED, "true"),
        "secret": (
            r"[A-Za-z0-9+/_-]{20,}={0,2}",
            f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND {entropy} >= 3 AND regexp_matches({near}, '\\b(?:{pii.SECRETS})')",
        ),
        "ssn": (
            r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
            f"NOT regexp_matches({beside}, '[0-9A-Za-z-]') AND NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$') AND regexp_matches({near}, '\\b(?:ssn|social security|taxpayer)')",
        ),
    }
    each = "\nUNION ALL\n".join(
        f"""SELECT * FROM (SELECT doc_id, {k} AS k, '{name}' AS kind, t, unnest(m) AS v, unnest(list_transform(range(1, len(m) + 1),
          lambda i: cast(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s
        FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d)) WHERE {valid}"""
        for k, (name, (pattern, valid)) in enumerate(kinds.items())
    )
    count = ", ".join(f"coalesce(count(*) FILTER (kind = '{name}'), 0) AS n_{name}" for name in kinds)
    text = "coalesce(string_agg(kind || ':' || cast(s AS BIGINT) || ':' || cast(s + length(v) AS BIGINT), ',' ORDER BY k, s){where}, '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({each})
SELECT doc_id, {count}, sha256({text.format(where=" FILTER (k < 4)")}) AS base_sha256, {text.format(where="")} AS spans,
  count(kind) AS n_spans, count(kind) > 0 AS has_pii
FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id"""


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, cast(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
FROM f
"""

OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
),
t AS (SELECT *, trim(translate(line, chr(9) || chr(13), '  ')) AS key FROM l),
pages AS (SELECT coalesce(source, '') AS site, count(*) AS pages FROM documents GROUP BY 1),
bad AS (
  SELECT site, key FROM (SELECT site, key, count(DISTINCT doc_id) AS n FROM t WHERE key <> '' GROUP BY ALL) JOIN pages USING (site) WHERE n >= 5 AND n > pages * 0.01::DOUBLE
),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (b.key IS NOT NULL) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (b.key IS NULL), '') AS rest
  FROM t LEFT JOIN bad b ON t.site = b.site AND t.key = b.key GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN n_dropped > 0 THEN rest ELSE text END AS text
FROM documents LEFT JOIN k USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op5_pii": _pii_sql(),
    "op6_warc": OP6_SQL,
    "op10_line_dedup": OP10_SQL,
    "quality_rule_ablations": ABLATIONS_SQL,
}
