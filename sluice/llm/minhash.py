"""Near-duplicate detection: MinHash bands propose, odd sketches estimate, full sets confirm.

A document is its set of distinct five-word shingles. Equal sets are one class,
whatever their number, and only a class's smallest document goes on. Bands of
MinHash values put similar sets into common buckets. An odd sketch folds MinHash
samples of a set, its smallest hashes, into a parity bitmap; the population count
of the XOR of two bitmaps estimates a high similarity closely, exactly but for
folding where the sets are small, so most chance encounters in a bucket end there. What remains is confirmed on the full sets.

Buckets are never expanded into pairs:

1. Every set is tested against one centre, the smallest document of the bucket it
   shares most often. Groups of near copies become components here, with work in
   proportion to their size.
2. Buckets whose members still lie in several components go, cut into blocks, to
   a kernel that compares bitmaps in arrays: members outside the bucket's largest
   component with all others. For each it puts out the nearest partner of another
   component, once; confirmed ones merge.
3. Then every untested pair between components that the bitmaps admit is tested,
   for the members that had a partner at all. Large components with a link have
   merged by their nearest pairs, so few pairs are left.

So no link between members of a bucket is lost, and pairs inside a component,
which could not change the result, are never made. To confirm pairs, the document
with more pairs of the two is the hub and the other's set travels to it; a hub of
many pairs has several places, so no task gets a whole group of near copies.
Tables that no later step reads are deleted on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import broadcast_if_small, clean_shuffles, discard, give_back, small_batches, stored
from sluice.llm.components import components, roots

SHINGLE = 5
#: Similarity from which documents are linked, as a percentage.
PERCENT = 75
#: A pair at 0.75 misses all of 48 bands of 5 values with a probability of 2.3e-6, one at 0.8 with 5e-9; one at 0.3 shares a band with 0.11.
BANDS, ROWS = 48, 5
#: MinHash samples of an odd sketch (the smallest values of the set; smaller sets go in whole) and its bits.
SAMPLES, BITS = 512, 2048
#: Standard deviations of sampling by which a pair of sets above SAMPLES must miss 0.75 to be ruled out: the hypergeometric tail there is below 1e-20.
MARGIN = 12
#: Most members of a block in the kernel.
BLOCK = 1024
#: Pairs of a hub that are confirmed in one place, about.
PLACE = 64
#: Words whose hashes a worker keeps.
CACHE = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; null and wordless texts have none."""
    weights = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    sets = []
    for text in texts:
        # bytes.lower() and bytes.split() know ASCII alone, as the words are defined.
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
        n = len(words)
        if not n:
            sets.append(np.empty(0, np.uint64))
            continue
        w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        if n < SHINGLE:
            own = mix((w * weights[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            own = w[: n - SHINGLE + 1] * weights[0]
            for k in range(1, SHINGLE):
                own += w[k : n - SHINGLE + 1 + k] * weights[k]
            own = np.unique(mix(own))
        sets.append(own)
    return sets


def signature(own: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """MinHash values of a set under each seed: multiply-shift of the upper halves of well mixed hashes, in blocks that stay in cache."""
    high, by = (own >> np.uint64(32)).astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = np.full(len(seeds), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), 256):
        block = high[at : at + 256, None] * by
        np.minimum(low, block.min(axis=0), out=low)
    return low.astype(np.uint64)


def seeds() -> np.ndarray:
    return mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def odd_sketch(own: np.ndarray) -> bytes:
    """Bit b is the parity of the samples that fall on b. The hashes are sorted, so the smallest ones come first."""
    place = (own[:SAMPLES] >> np.uint64(7)) % np.uint64(BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def admitted(na, nb, apart) -> np.ndarray:
    """Whether sets of na and nb shingles, whose sketches differ in so many bits, may have a similarity of 0.75.

    At 0.75 the sets share 3/7 of na + nb. Samples are common at the rate of the larger
    set, and each sample that differs toggles a bit. Never more bits differ than
    samples do, so sets that went in whole are ruled out without any error.
    """
    na, nb = np.asarray(na, np.float64), np.asarray(nb, np.float64)
    low, high, share = np.minimum(na, nb), np.maximum(na, nb), PERCENT / (100 + PERCENT)
    rate = np.minimum(1, SAMPLES / high)
    common = share * (na + nb) * rate
    taken = np.minimum(na, SAMPLES) + np.minimum(nb, SAMPLES)
    p = np.clip(common / np.minimum(high, SAMPLES), 0, 1)
    # Each sample that is not common after all is two bits, one in either sketch.
    sampling = np.where(rate < 1, MARGIN * np.sqrt(SAMPLES * p * (1 - p)) + 10, 0)
    toggles = taken - 2 * common + sampling
    return (100 * low >= PERCENT * high) & (apart <= toggles)


def describe(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (set size), fp (fingerprint of the set; null if empty), bands (a hash for each) and sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes, of = WordHashes(), seeds()
        for batch in batches:
            rows = []
            for own in shingle_sets(batch[text], hashes):
                if not len(own):
                    rows.append((0, None, None, None))
                    continue
                low = signature(own, of)
                band = mix((low.reshape(BANDS, ROWS) * of[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
                rows.append((len(own), xxhash.xxh3_128_digest(own.tobytes()), band.view(np.int64), odd_sketch(own)))
            out = pd.DataFrame(rows, columns=["n", "fp", "bands", "sketch"])
            out.insert(0, "doc", batch[doc_id].to_numpy())
            yield out
        del hashes
        give_back()

    return docs.select(doc_id, text).mapInPandas(run, "doc long, n long, fp binary, bands array<long>, sketch binary")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(both) - common)


def routes(pairs: DataFrame) -> DataFrame:
    """doc, hubs, places, n: for each document of the pairs the hubs that its set travels to, the place at each, and its own number of places.

    Of a pair, the document with more pairs is the hub. So a document travels to at most
    the square root of twice the number of pairs.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    sided = pairs.join(ends.toDF("a", "_na"), "a").join(ends.toDF("b", "_nb"), "b")
    first = F.col("_na") >= F.col("_nb")
    hubs = sided.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("spoke"),
        F.expr(f"int(ceil(greatest(_na, _nb) / {PLACE}))").alias("n"),
    )
    spokes = hubs.select(F.col("spoke").alias("doc"), F.struct("hub", F.expr("int(pmod(xxhash64(spoke), n))").alias("place")).alias("at"), F.lit(0).alias("n"))
    both = spokes.union(hubs.select(F.col("hub").alias("doc"), F.lit(None).cast("struct<hub:bigint,place:int>").alias("at"), "n"))
    per_doc = both.groupBy("doc").agg(F.collect_list("at").alias("_at"), F.max("n").alias("n"))
    return per_doc.select("doc", F.col("_at.hub").alias("hubs"), F.col("_at.place").alias("places"), "n")


def tests(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """pairs (a, b) with linked (boolean), decided on the full sets."""
    import pyarrow as pa

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            # A few hundred texts at a time: their sets are larger than they are.
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                own = pa.array([x.tobytes() for x in shingle_sets(part.column("text").to_pylist(), hashes)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc", "hubs", "places", "n")), own], names=["doc", "hubs", "places", "n", "own"])
        del hashes
        give_back()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub_sets = None, []
        for batch in batches:
            a, b, found = [], [], []
            own = batch.column("own")
            for k, (hub, place, spoke, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hub", "place", "spoke", "doc")), strict=True)):
                x = np.frombuffer(own[k].as_buffer(), np.uint64)
                if (hub, place) != now:
                    now, hub_sets = (hub, place), []
                if not spoke:
                    hub_sets.append(x.copy())
                    continue
                a.append(min(hub, doc))
                b.append(max(hub, doc))
                found.append(any(linked(x, y) for y in hub_sets))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found, pa.bool_())], names=["a", "b", "linked"])
        give_back()

    wanted = stored(routes(pairs), "routes")
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(broadcast_if_small(wanted, "24 + 16 * size(hubs)"), "doc")
    own = texts.select("doc", "hubs", "places", "n", "text").mapInArrow(sets, "doc long, hubs array<long>, places array<int>, n int, own binary")
    places = (
        "concat(transform(arrays_zip(hubs, places), x -> named_struct('hub', x.hubs, 'place', x.places, 'spoke', true)), "
        "CASE WHEN n > 0 THEN transform(sequence(0, n - 1), i -> named_struct('hub', doc, 'place', i, 'spoke', false)) ELSE array() END)"
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = own.select(F.inline(F.expr(places)), "doc", "own").repartition(parts, "hub", "place").sortWithinPartitions("hub", "place", "spoke")
    found = met.select("hub", "place", "spoke", "doc", "own").mapInArrow(compare, "a long, b long, linked boolean")
    # Rows that share an id are one document: any of their texts can link it.
    done = stored(found.groupBy("a", "b").agg(F.max("linked").alias("linked")), "confirmed")
    discard(wanted)
    clean_shuffles(docs.sparkSession)
    return done


def kernel(groups: DataFrame, best: bool) -> DataFrame:
    """bucket, d, a, b, apart: pairs (a, b) of members of different components that size and sketch admit, d being the row's member.

    groups: bucket, part (of the grid), side (0: rows, 1: columns), doc, comp, n, sketch.
    best: for each row only its nearest column in each part. Rows of a part arrive
    together; one part at a time is held.
    """

    def pairs(g: pd.DataFrame) -> list[tuple[int, int, int, int, int]]:
        one, two = g[g["side"] == 0], g[g["side"] == 1]
        if not len(one):
            return []
        s1, s2 = (np.frombuffer(b"".join(x["sketch"]), np.uint64).reshape(len(x), -1) for x in (one, two))
        n1, n2, c1, c2, d1, d2 = (x[k].to_numpy() for k in ("n", "comp", "doc") for x in (one, two))
        bucket = int(g["bucket"].iloc[0])
        out: list[tuple[int, int, int, int, int]] = []
        for i in range(len(one)):
            apart = np.bitwise_count(s2 ^ s1[i]).sum(axis=1, dtype=np.int64)
            ok = np.flatnonzero((c2 != c1[i]) & admitted(n1[i], n2, apart))
            if len(ok) and best:
                ok = ok[np.lexsort((d2[ok], apart[ok]))[:1]]
            out += [(bucket, int(d1[i]), int(min(d1[i], d)), int(max(d1[i], d)), int(x)) for d, x in zip(d2[ok], apart[ok], strict=True)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["bucket", "d", "a", "b", "apart"]
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            whole = pd.concat(held) if len(held) > 1 else batch
            bucket, part = whole["bucket"].to_numpy(), whole["part"].to_numpy()
            ends = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
            found = [p for a, b in zip([0, *ends], ends) for p in pairs(whole.iloc[a:b])]
            held = [whole.iloc[ends[-1] if len(ends) else 0 :]]
            yield pd.DataFrame(found, columns=names)
        if held:
            yield pd.DataFrame(pairs(pd.concat(held)), columns=names)

    return groups.mapInPandas(run, "bucket long, d long, a long, b long, apart long")


def spread(members: DataFrame) -> DataFrame:
    """(bucket, doc, comp, row): members of buckets that span components; a bucket that repeats another's members is left out.

    Members outside a bucket's largest component are rows, to be compared with all
    members: within the largest component nothing is.
    """
    comps = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("_n"), F.expr("bit_xor(xxhash64(doc))").alias("_x"), F.expr("sum(pmod(xxhash64(doc, 7), 1000000007))").alias("_y"))
    mixed = (
        comps.groupBy("bucket")
        .agg(F.sum("_n").alias("_m"), F.max(F.struct("_n", "comp")).alias("_top"), F.min("comp").alias("_c"), F.max("comp").alias("_d"), F.expr("bit_xor(_x)").alias("_x"), F.sum("_y").alias("_y"))
        .filter("_c < _d")
        .groupBy("_m", "_x", "_y")
        .agg(F.min(F.struct("bucket", "_top")).alias("_b"))
        .select("_b.bucket", F.col("_b._top.comp").alias("_major"))
    )
    # A sort-merge join, whose hot partitions adaptive execution splits.
    return members.join(mixed.hint("merge"), "bucket").select("bucket", "doc", "comp", (F.col("comp") != F.col("_major")).alias("row"))


def blocks(members: DataFrame, light: DataFrame) -> DataFrame:
    """Rows and all members of each bucket as the two sides of a grid, cut into blocks; a part of the grid is one block of each."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_m"), F.count_if("row").alias("_r")).filter("_r > 0")
    # Written first: adaptive execution splits a hot bucket only where an exchange is right below the join.
    sizes = stored(sizes.select("bucket", F.expr(f"int(ceil(_m / {BLOCK}))").alias("_columns"), F.expr(f"int(ceil(_r / {BLOCK}))").alias("_rows")), "sizes")
    own = members.join(sizes.hint("merge"), "bucket").withColumns({"_i": F.expr("int(pmod(xxhash64(doc, 13), _rows))"), "_j": F.expr("int(pmod(xxhash64(doc, 11), _columns))")})
    places = (
        "concat(transform(sequence(0, _rows - 1), i -> named_struct('part', i * _columns + _j, 'side', 1)), "
        "CASE WHEN row THEN transform(sequence(0, _columns - 1), j -> named_struct('part', _i * _columns + j, 'side', 0)) ELSE array() END)"
    )
    groups = own.select("bucket", F.inline(F.expr(places)), "doc", "comp").join(light, "doc")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document.

    component_id is the smallest document reachable over links of similarity 0.75 or
    more, kept whether that is the document itself. Null, empty and wordless texts
    are linked with nothing. doc_id is an integer. Rows that share one are one
    document, linked with whatever any of their texts links, and kept or not together;
    n_shingles is each row's own. Rows without one are linked with nothing and kept.
    Other columns don't matter.
    """
    nameless = docs.filter(F.col(doc_id).isNull()).select(F.lit(0).cast("long").alias("doc"), F.col(text).alias("text"))
    docs = docs.filter(F.col(doc_id).isNotNull())
    with small_batches(docs.sparkSession):
        all_docs = stored(describe(docs, doc_id, text), "described")
    classes = stored(all_docs.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc").alias("doc")), "classes")
    # Copies of a set have its bands too; only the smallest document's go on.
    reps = all_docs.select("doc", "fp", "bands").join(classes, ["doc", "fp"], "left_semi")
    banded = reps.select("doc", F.posexplode("bands").alias("_k", "_v")).select("doc", F.expr("xxhash64(_k, _v)").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("doc").alias("centre"), F.max("doc").alias("_last")).filter("centre < _last")
    shared = stored(shared, "shared")
    members = stored(banded.join(shared.hint("merge"), "bucket").select("bucket", "doc", "centre"), "members")
    discard(shared)
    clean_shuffles(docs.sparkSession)

    # Sketches of documents that share a bucket, few of all.
    named = members.select("doc").distinct()
    light = all_docs.select("doc", "fp", "n", "sketch").join(broadcast_if_small(named, "16"), "doc", "left_semi").join(classes, ["doc", "fp"], "left_semi")
    light = stored(light.select("doc", "n", "sketch"), "light")
    tested = first_round(members, light, docs, doc_id, text)
    links = tested.filter("linked")
    near = roots(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
    placed = lambda m, comps: m.join(comps.toDF("doc", "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))

    residue = stored(spread(placed(members.select("bucket", "doc"), near)), "residue")
    discard(members, near)
    clean_shuffles(docs.sparkSession)
    nearest = stored(kernel(blocks(residue, light), True), "nearest")
    # Of the partners that a row has in several parts and buckets, the nearest.
    pairs = nearest.groupBy("d").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    pairs = stored(pairs, "pairs")
    second = tests(pairs, docs, doc_id, text)
    comps = components(tested.union(second).filter("linked"))
    # Rows that had no partner have none now, and buckets without other rows have nothing left.
    live = stored(nearest.select("bucket", F.col("d").alias("doc")).distinct().withColumn("row", F.lit(True)), "live")
    buckets = stored(live.select("bucket").distinct(), "buckets")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = residue.select("bucket", "doc").join(buckets.hint("merge"), "bucket", "left_semi").repartition(n, "bucket", "doc")
    left = stored(placed(left.join(live, ["bucket", "doc"], "left").withColumn("row", F.coalesce("row", F.lit(False))), comps), "left")
    discard(residue, nearest, pairs, live, buckets)
    clean_shuffles(docs.sparkSession)
    pairs = kernel(blocks(left, light), False).select("a", "b").distinct().join(tested.union(second).select("a", "b"), ["a", "b"], "left_anti")
    pairs = stored(pairs, "pairs")
    discard(left, light)
    clean_shuffles(docs.sparkSession)
    twins = stored(twice(all_docs, classes), "twins")
    if not (pairs.isEmpty() and twins.isEmpty()):
        edges = tested.union(second).filter("linked").select("a", "b").union(twins)
        third = None if pairs.isEmpty() else tests(pairs, docs, doc_id, text)
        discard(comps)
        comps = components(edges if third is None else edges.union(third.filter("linked").select("a", "b")))
        discard(third)
    discard(tested, second, pairs, twins)

    of = classes.join(comps.toDF("doc", "_root"), "doc", "left").select("fp", F.coalesce("_root", "doc").alias("component_id"))
    joined = all_docs.select("doc", "n", "fp").join(of, "fp", "left")
    component = F.coalesce("component_id", "doc")
    found = joined.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc")).alias("kept"))
    if nameless.isEmpty():
        return found
    none = F.lit(None).cast("long")
    return found.unionByName(describe(nameless, "doc", "text").select(none.alias(doc_id), F.col("n").alias("n_shingles"), none.alias("component_id"), F.lit(True).alias("kept")))


def twice(all_docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the classes of ids that come with several sets, each linked with the id."""
    ids = all_docs.filter("fp IS NOT NULL").groupBy("doc").agg(F.min("fp").alias("_x"), F.max("fp").alias("_y")).filter("_x < _y").select("doc")
    own = all_docs.select("doc", "fp").join(ids, "doc", "left_semi").distinct()
    return own.join(classes.toDF("fp", "a"), "fp").select("a", F.col("doc").alias("b")).distinct()


def first_round(members: DataFrame, light: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Tested pairs (a, b, linked): each document with the centre that it shares most buckets with."""
    often = members.filter("doc <> centre").groupBy("doc", "centre").agg(F.count(F.lit(1)).alias("_often"))
    one = often.groupBy("doc").agg(F.max(F.struct("_often", (-F.col("centre")).alias("_c"))).alias("_x"))
    pairs = one.select((-F.col("_x._c")).alias("a"), F.col("doc").alias("b"))
    sided = pairs.join(light.toDF("a", "na", "sa"), "a").join(light.toDF("b", "nb", "sb"), "b")
    possible = sided.filter(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[k]), np.uint64).reshape(len(batch), -1) for k in ("sa", "sb"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield batch.loc[admitted(batch["na"], batch["nb"], apart), ["a", "b"]]

    pairs = stored(possible.mapInPandas(near, "a long, b long").distinct(), "pairs")
    done = tests(pairs, docs, doc_id, text)
    discard(pairs)
    return done


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group: the rows that are their component's smallest."""
    gone = near_duplicates(docs.select(doc_id, text), text, doc_id).filter("NOT kept").select(doc_id)
    return docs.join(gone, doc_id, "left_anti")
