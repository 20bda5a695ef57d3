import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import components, minhash
from tests.llm.helpers import clashing, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in held[x])
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
        for x in s:
            held[x].append(k)
    return [(len(s), find(k), find(k) == k) for k, s in enumerate(sets)]


def edited(rng, words, share):
    return [w if rng.random() > share else f"n{rng.randint(0, 10**6)}" for w in words]


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "a", "A", "a b c d", "a b c d e", "É b", "é b"]
    for k in range(12):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 700))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            texts.append("  ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.04, 0.05]))).upper())
    texts += [texts[9]] * 5
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(clashing(documents(spark, texts))).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_hot_group_of_near_copies_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "PLACE", 16)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.05]))) for _ in range(90)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_nameless_repeated_and_empty(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "q r s t u v", "q r s t u v"], ids=[None, None, 7, 7])
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=repr)
    assert got == [(7, 7, True), (7, 7, True), (None, None, True), (None, None, True)]
    assert minhash.deduplicated(docs).count() == 4
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.near_duplicates(documents(spark, [None, "", " "])).filter("kept").count() == 3


def test_rows_that_share_an_id_are_one_document(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    near = lambda t: t + " tail"
    docs = documents(spark, [one, two, near(one), near(two), three], ids=[5, 5, 3, 8, 9])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (8, 3, False), (9, 9, True)]


def test_given_tables_against_brute_force(spark):
    """All documents of a given table, sets compared without bands or sketches."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no given tables here")
    docs = spark.read.parquet(path)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    ids = [k for k, _ in rows]
    want = {ids[k]: (n, ids[c], kept) for k, (n, c, kept) in enumerate(brute([t for _, t in rows]))}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()} == want


def test_sketch_never_rules_out_small_sets_and_seldom_larger_ones():
    rng = np.random.default_rng(6)
    for n, trials in ((40, 200), (400, 200), (3000, 200)):
        for _ in range(trials):
            common = int(np.ceil(6 * n / 7))
            a = np.unique(rng.integers(0, 2**63, 2 * n - common).astype(np.uint64))
            x, y = np.sort(a[rng.permutation(len(a))][:n]), None
            rest = np.setdiff1d(a, x)
            y = np.sort(np.concatenate([rng.permutation(x)[:common], rest[: n - common]]))
            apart = np.bitwise_count(np.frombuffer(minhash.odd_sketch(x), np.uint64) ^ np.frombuffer(minhash.odd_sketch(y), np.uint64)).sum()
            assert minhash.admitted(len(x), len(y), int(apart))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and {got[k] for k in (90, 95, 100)} == {90} and got[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicated_keeps_columns(spark):
    docs = clashing(documents(spark, ["a b c d e f g h", "A b c d e f g h", "z"]))
    out = minhash.deduplicated(docs)
    assert set(out.columns) == set(docs.columns) and {r["doc_id"] for r in out.collect()} == {0, 2}
    assert out.filter(F.col("doc_id") == 0).count() == 1
