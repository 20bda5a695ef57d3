"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of ten words. A window can only occur in a
document that holds its rarest word, so that word is the prefix which an exact
containment needs. Words are ordered by how often they occur over all documents;
each window is filed under its rarest one. Documents' words are joined with these
entries; length and place bounds discard what cannot fit, and the words around a
candidate are compared with the window's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import NON_WORD, ascii_lower, broadcast_if_small, stored, words_of

WINDOW = 10
#: Entries are broadcast up to so many bytes; beyond, they are joined by shuffled words.
BROADCAST_BYTES = 64 << 20


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    t = ascii_lower(F.col(text))
    return items.select(F.col(item_id).cast("string").alias("_item"), words_of(t, NON_WORD).alias("_iw")).filter("size(_iw) > 0")


def entries(words: DataFrame, items: DataFrame) -> DataFrame:
    """_word, _off, _window, _items: each window of the items under its rarest word, the word's place in it, and the items that hold it.

    words: documents' words, for the corpus counts.
    """
    vocabulary = stored(items.select(F.explode(F.array_distinct("_iw")).alias("_word")).distinct(), "vocabulary")
    counts = (
        words.select(F.explode("_w").alias("_word"))
        .join(broadcast_if_small(vocabulary, "octet_length(_word) + 24", BROADCAST_BYTES), "_word")
        .groupBy("_word")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # Equal items are one entry with several ids.
    texts = items.groupBy("_iw").agg(F.sort_array(F.collect_set("_item")).alias("_items"))
    texts = texts.withColumn("_key", F.sha2(F.array_join("_iw", " "), 256))
    placed = texts.select("_key", F.posexplode("_iw").alias("_at", "_word")).join(counts, "_word", "left")
    ranked = placed.groupBy("_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("_rank")
    )
    length = f"least({WINDOW}, size(_iw))"
    rarest = f"array_min(transform(slice(_rank, _s + 1, _len), (n, i) -> struct(n, i))).i"
    windows = (
        texts.join(ranked, "_key")
        .withColumn("_len", F.expr(length))
        .withColumn("_s", F.explode(F.expr("sequence(0, size(_iw) - _len)")))
        .withColumn("_off", F.expr(rarest))
        .select(F.expr("_iw[_s + _off]").alias("_word"), "_off", F.expr("slice(_iw, _s + 1, _len)").alias("_window"), "_items")
    )
    # A window that several items share is one entry too.
    return windows.groupBy("_word", "_off", "_window").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))


#: Names a row among those that share its id, or have none, whatever text the row has.
KEY = ("_hash", "_check")


def with_key(docs: DataFrame, text: str, *columns) -> DataFrame:
    return docs.select(*columns, F.xxhash64(text).alias(KEY[0]), F.hash(text).alias(KEY[1]))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids): a row for each row of docs.

    Null and empty texts have no words; items without words never occur; an empty
    benchmark leaves every document clean. Rows that share an id, or have none, are
    documents of their own, each judged by its own text.
    """
    return judged(docs, items, text, doc_id, item_id, item_text).drop(*KEY)


def judged(docs: DataFrame, items: DataFrame, text: str, doc_id: str, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """contamination() and the rows' KEY."""
    items = item_words(items, item_id, item_text)
    words = with_key(docs, text, F.col(doc_id).alias("_doc"), words_of(ascii_lower(F.col(text)), NON_WORD).alias("_w"))
    filed = stored(entries(words, items), "entries")
    size = "octet_length(_word) + coalesce(aggregate(_window, 64L, (a, x) -> a + octet_length(x) + 24), 0) + coalesce(aggregate(_items, 0L, (a, x) -> a + octet_length(x) + 24), 0)"
    small = filed.agg(F.coalesce(F.sum(F.expr(size)), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_BYTES
    found = by_broadcast(words, filed) if small else by_shuffle(words, filed)
    per_doc = found.groupBy("_doc", *KEY).agg(
        # Equal rows are counted, and come back as often.
        F.max("n_words").cast("long").alias("n_words"),
        F.count("n_words").alias("_rows"),
        F.sort_array(F.collect_set(F.expr("CASE WHEN _items IS NOT NULL THEN named_struct('s', s, 'e', e) END"))).alias("_spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
    )
    covered = "aggregate(_spans, named_struct('e', 0, 'n', 0L), (a, x) -> named_struct('e', greatest(a.e, x.e), 'n', a.n + greatest(0, x.e - greatest(a.e, x.s))), a -> a.n)"
    once = per_doc.select(
        F.col("_doc").alias(doc_id),
        *KEY,
        "n_words",
        F.expr(covered).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        "items",
        F.explode(F.expr("sequence(1L, _rows)")).alias("_row"),
    )
    return once.drop("_row")


BOUNDS = "_pos >= _off AND _pos - _off + size(_window) <= {size}"
EQUAL = "slice(_w, greatest(_pos - _off, 0) + 1, size(_window)) = _window"


def hits(found: DataFrame) -> DataFrame:
    return found.select("_doc", *KEY, "n_words", (F.col("_pos") - F.col("_off")).alias("s"), (F.col("_pos") - F.col("_off") + F.size("_window")).alias("e"), "_items")


def by_broadcast(words: DataFrame, filed: DataFrame) -> DataFrame:
    """_doc, KEY, n_words, s, e, _items: a row for each window found, and one with n_words and no items for each document."""
    # An empty word, which no text has, stands after a document's last one and carries its number of words: texts are split once.
    last = filed.sparkSession.createDataFrame([("",)], "_word string")
    filed = filed.unionByName(last, allowMissingColumns=True)
    placed = words.select("_doc", *KEY, "_w", F.posexplode(F.array_append("_w", F.lit(""))).alias("_pos", "_at"))
    # The bounds and the comparison are part of the join's condition: generated code hands the words on
    # by reference, so a candidate that fails is never a row.
    on = (F.col("_at") == F.col("_word")) & F.expr(f"_window IS NULL OR ({BOUNDS.format(size='size(_w)')} AND {EQUAL})")
    found = placed.join(F.broadcast(filed), on)
    return hits(found.withColumn("n_words", F.expr("CASE WHEN _items IS NULL THEN _pos END")))


def by_shuffle(words: DataFrame, filed: DataFrame) -> DataFrame:
    """The same rows where the entries are too large to broadcast: candidates first, then the words of the documents that have any.

    Only words that some entry is filed under move, and numbers of words come from the
    rows themselves. Ids are compared null-safely, with the rows' KEY.
    """
    none = F.lit(None)
    sizes = words.select("_doc", *KEY, F.size("_w").alias("n_words"), none.cast("int").alias("s"), none.cast("int").alias("e"), none.cast("array<string>").alias("_items"))
    vocabulary = stored(filed.select("_word").distinct(), "vocabulary")
    places = words.select("_doc", *KEY, F.size("_w").alias("_size"), F.posexplode("_w").alias("_pos", "_word"))
    places = places.join(broadcast_if_small(vocabulary, "octet_length(_word) + 24", BROADCAST_BYTES), "_word", "left_semi")
    candidates = places.join(filed, (places["_word"] == filed["_word"]) & F.expr(BOUNDS.format(size="_size")))
    # Equal rows have the same candidates: once is enough, and k of them are not k x k rows.
    candidates = candidates.select("_doc", *KEY, "_pos", "_off", "_window", "_items").distinct()
    own = words.select(F.col("_doc").alias("_own"), F.col(KEY[0]).alias("_own_hash"), F.col(KEY[1]).alias("_own_check"), "_w")
    found = candidates.join(own, F.expr("_doc <=> _own AND _hash = _own_hash AND _check = _own_check")).filter(EQUAL)
    return sizes.unionByName(hits(found.withColumn("n_words", none.cast("int"))))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that hold no window of any item, each judged by its own text, with or without an id."""
    bad = judged(docs, items, text, doc_id).filter("contaminated").select(F.col(doc_id).alias("_bad"), *KEY).distinct()
    bad = stored(bad, "contaminated")
    on = docs[doc_id].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs[text]) == bad[KEY[0]]) & (F.hash(docs[text]) == bad[KEY[1]])
    return docs.join(broadcast_if_small(bad, "32"), on, "left_anti")
