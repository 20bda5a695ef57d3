"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, other columns with names used inside."""

from pyspark.sql import functions as F

CLASHING = ("_t", "_w", "_doc", "_site", "_lines", "_drop", "_row", "doc", "n", "text_", "bands", "bucket", "comp", "sketch", "page", "value", "score", "kept")


def documents(spark, texts, source="s", ids=None):
    rows = [(k if ids is None else ids[k], t, "en", source if isinstance(source, str) else source[k], None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
