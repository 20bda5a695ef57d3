"""Line deduplication by site-relative frequency.

Lines are counted per site: the pages of a site that hold a line, divided by all
of its pages. A line above a ratio, on enough pages, is boilerplate of that site
and is dropped from every page of it.

A site has few such lines however large it is: the ratios of its lines add up to
its mean number of distinct lines, so at most that mean over the ratio exceed it.
They therefore travel as one array per site. Long lines can have a lower ratio of
their own (long_ratio); it is off unless given, since every copy of a line goes, the
last one too: README has the figures. Texts never shuffle on the broadcast
path; counting moves distinct lines, summed before they move, so a site with a
third of all pages is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import stored

#: Production parameters: the share of a site's pages above which a line is boilerplate, and the least pages that it must be on.
RATIO, LEAST_PAGES = 0.01, 5
#: Lines of so many words can have a ratio of their own, and then go from so many pages on.
LONG_WORDS, LONG_PAGES = 50, 2
#: The boilerplate table is broadcast up to so many bytes of lines; beyond, it is joined by shuffled, salted keys.
BROADCAST_BYTES = 64 << 20
SALTS = 64


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, for pages."""
    return F.lower(F.parse_url(url, F.lit("HOST")))


def boilerplate(docs: DataFrame, site: Column, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, long_ratio: float | None = None) -> DataFrame:
    """_site, _lines: the sorted boilerplate lines of each site that has any. Lines compare without the blanks around them; blank lines never count.

    With long_ratio, lines of LONG_WORDS words are boilerplate above that ratio too, from LONG_PAGES pages on.
    """
    frequent, often = F.col("_n") >= least_pages, F.col("_n") > F.col("_pages") * ratio
    above = frequent & often
    if long_ratio is not None:
        long = F.size(F.array_remove(F.split("_line", " "), "")) >= LONG_WORDS
        frequent = frequent | ((F.col("_n") >= LONG_PAGES) & long)
        above = above | ((F.col("_n") >= LONG_PAGES) & (F.col("_n") > F.col("_pages") * long_ratio) & long)
    lines = docs.select(F.coalesce(site, F.lit("")).alias("_site"), F.array_distinct(trimmed(F.col(text))).alias("_lines"))
    pages = lines.groupBy("_site").agg(F.count(F.lit(1)).alias("_pages"))
    counts = (
        lines.select("_site", F.explode("_lines").alias("_line"))
        .filter("_line <> ''")
        .groupBy("_site", "_line")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(frequent)
    )
    return (
        counts.join(pages, "_site")
        .filter(above)
        .groupBy("_site")
        .agg(F.sort_array(F.collect_list("_line")).alias("_lines"))
    )


def trimmed(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(F.translate(x, "\t\r", "  ")))


def drop_lines(docs: DataFrame, site: Column, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, long_ratio: float | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_lines, n_dropped (long).

    Null and empty texts stay as they are, with n_lines 0 for null. Null and empty
    sites are one site. Rows keep their number and other columns; columns of docs named
    n_lines or n_dropped give way.
    """
    found = stored(boilerplate(docs, site, text, ratio, least_pages, long_ratio).withColumnRenamed("_lines", "_drop"), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.expr("aggregate(_drop, 0L, (a, x) -> a + octet_length(x) + 16) + octet_length(_site)")), F.lit(0)).alias("n")).first()["n"]
    # The row goes along as one column, so its names can't clash with those used here.
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(site, F.lit("")).alias("_site"), F.col(text).alias("_text"))
    if size <= BROADCAST_BYTES:
        both = keyed.join(F.broadcast(found), "_site", "left")
    else:
        salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = keyed.withColumn("_salt", F.expr(f"int(pmod(xxhash64(_text), {SALTS}))")).join(salted, ["_site", "_salt"], "left")
    lines = both.withColumn("_all", F.split("_text", "\n", -1))
    kept = lines.withColumn(
        "_kept",
        F.when(F.col("_drop").isNull(), F.col("_all")).otherwise(
            F.filter("_all", lambda x: ~F.array_contains(F.col("_drop"), F.trim(F.translate(x, "\t\r", "  "))))
        ),
    )
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    new = F.when(F.size("_kept") < F.size("_all"), F.array_join("_kept", "\n")).otherwise(F.col("_text"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return kept.select(
        *[new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in own], n("_all").alias("n_lines"), (n("_all") - n("_kept")).alias("n_dropped")
    )
