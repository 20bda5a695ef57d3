"""Token files, packing and WARC bundles: exact round trips."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from sluice.llm import packing, rans, token_output, tokens, warc
from tests.llm.helpers import clashing, documents

TEXTS = [None, "", " ", "Hello, world!", "Don't <|endoftext|> a<|x|>b", "é" * 50, "word " * 9000, "ÀÉÎ naïve 1,234.5 #$%", "same", "same"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_equals_the_tokenizer(tokenizer):
    import random

    rng = random.Random(1)
    alphabet = "aAbB1,.'<|>é̸́\xa0 \n\x1c²ßΣ*-tTsSendoftextÿ÷×öø日"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = tokens.encoder(tokens.tokenizer_path()).ids(texts)
    assert [list(np.frombuffer(x, "<u4")) for x in got] == [ids_of(tokenizer, t, 0)[:-1] for t in texts]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 3 * rans.EVERY + 17])
def test_rans(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 49000).astype(np.uint32)
    table = rans.Table.of(np.bincount(ids, minlength=3))
    assert table.freq.sum() == 1 << rans.BITS
    coder = rans.Coder(rans.Table.from_bytes(table.to_bytes()))
    block = token_output.pack_block(coder, ids, [(5, 0, n)])
    back, docs = token_output.unpack_block(coder, block)
    assert (back == ids).all() and docs.tolist() == [[5, 0, n]]
    for mark in range(max(0, (n - 1) // rans.EVERY)):
        assert (token_output.unpack_from(coder, block, mark) == ids[(mark + 1) * rans.EVERY : (mark + 2) * rans.EVERY]).all()
    if n:
        spoiled = bytearray(block)
        spoiled[-1] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            token_output.unpack_block(coder, bytes(spoiled))


def test_token_files(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK", 4000)
    docs = clashing(documents(spark, TEXTS, ids=[9, 3, None, 5, 4, 1, 2, 8, 7, 7]))
    files = token_output.write(docs)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], list(r["ids"])) for r in token_output.read(files, each="ids").collect()))
    order = sorted(zip([9, 3, -(2**63), 5, 4, 1, 2, 8, 7, 7], TEXTS), key=lambda x: x[0])
    start = 0
    for (doc, text), (at, own, n, digest, ids) in zip(order, got, strict=True):
        want = ids_of(tokenizer, text, 1)
        assert (at, own, n, digest, ids) == (start, None if doc < 0 else doc, len(want), crc(want), want)
        start += len(want)
    assert token_output.read(token_output.write(docs.limit(0))).count() == 0


def test_differencing():
    assert packing.windows_of([], 10) == [] or packing.windows_of([], 10) == [[]]
    groups = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(i for g in groups for i in g) == [0, 1, 2, 3, 4]
    assert {sum([8, 7, 6, 5, 4][i] for i in g) for g in groups} <= {14, 16, 15}
    tight = packing.windows_of([6, 6, 6], 10)
    assert len(tight) == 3 and all(len(g) == 1 for g in tight)
    assert packing.padded(2048) == 2048 and packing.padded(2047) == 4096 and packing.padded(4096) == 4096


def dense(sizes, k):
    """Sums by plain differencing: vectors of all k windows, the two of the largest spread merged in opposite order."""
    parts = [[0] * (k - 1) + [s] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda v: v[0] - v[-1])
        one, two, *parts = parts
        parts.append(sorted(a + b for a, b in zip(one, reversed(two), strict=True)))
    return parts[0] if parts else [0] * k


def test_differencing_equals_the_plain_one():
    rng = np.random.default_rng(4)
    for _ in range(60):
        k = int(rng.integers(1, 9))
        # Sizes far apart: hardly two spreads are equal, so the order of merges is given.
        sizes = [int(x) for x in rng.choice(10**6, rng.integers(0, 30), replace=False) + 1]
        groups = packing.differencing(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(len(sizes))) and len(groups) == k
        assert sorted(sum(sizes[i] for i in g) for g in groups) == dense(sizes, k)


def test_documents_that_fit_are_seldom_cut(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no given tables here")
    pieces = packing.pack(spark.read.parquet(path).coalesce(1)).toPandas()
    fits = pieces[pieces["doc_tokens"] <= packing.CAPACITY]
    assert len(fits) - fits["doc_id"].nunique() <= 2


def test_packing(spark, tokenizer):
    docs = clashing(documents(spark, TEXTS * 30, ids=[None if k == 3 else k // 2 for k in range(300)]))
    pieces = packing.pack(docs, ids=True).toPandas()
    total = sum(len(ids_of(tokenizer, t, 2)) for t in TEXTS * 30)
    assert pieces["length"].sum() == total and (pieces.groupby("sequence_id")["length"].sum() <= 4096).all()
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
    assert all(crc(i) == c for i, c in zip(pieces["ids"], pieces["ids_crc32"]))
    unique = documents(spark, TEXTS)
    whole = packing.pack(unique, ids=True).toPandas().sort_values(["doc_id", "start"])
    for k, t in enumerate(TEXTS):
        own = whole[whole["doc_id"] == k]
        assert [x for i in own["ids"] for x in i] == ids_of(tokenizer, t, 2) and (own["doc_tokens"] == len(ids_of(tokenizer, t, 2))).all()
        assert (own["start"] == own["length"].cumsum() - own["length"]).all()
    sequences = packing.sequences(packing.pack(unique, ids=True)).collect()
    assert all(len(r["ids"]) == packing.padded(r["length"]) for r in sequences)
    assert packing.pack(unique.limit(0)).count() == 0


def test_packing_wastes_little(spark):
    docs = documents(spark, [f"word{k} " * (17 * k % 900 + 1) for k in range(3000)]).coalesce(1)
    lengths = packing.pack(docs).groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    room = sum(packing.padded(int(n)) for n in lengths)
    assert lengths.sum() > 0.97 * room


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 3000)
    big, other = "<p>é</p>" * 200, "y" * 1000
    html = [big, None, "", "small", "small", big, other, "y" * 999, "y" * 999, big, other]
    pages = clashing(spark.createDataFrame([(100 + k, None if k == 2 else f"http://h/{k}\r\nx: y", h) for k, h in enumerate(html)], "page_id long, url string, html string"))
    files = warc.write(pages)
    got = {r["page_id"]: r for r in warc.read(files).collect()}
    last = {h: k for k, h in enumerate(html) if h}
    for k, h in enumerate(html):
        data = (h or "").encode()
        first = 100 + last[h] if h and len(data) >= 1000 and last[h] != k else None
        r = got[100 + k]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if first else "response", first)
    seen = 0
    for f in files.collect():
        bundle = warc.Bundle(f["uri"])
        for page in bundle.places():
            fields, block = bundle.record(page)
            assert fields["WARC-Record-ID"] == f"<urn:sluice:page:{page}>"
            seen += 1
        import zstandard

        with open(f["uri"].removeprefix("file:"), "rb") as raw:
            plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert plain.count(b"WARC/1.1") == f["n_records"]
    assert seen == len(html) and warc.read(warc.write(pages.limit(0))).count() == 0


def test_warc_of_repeated_and_missing_ids(spark):
    big = "<p>é</p>" * 200
    given = [(5, "a"), (5, "b"), (5, big), (None, big), (None, "c"), (None, "c"), (7, big), (7, big), (3, big), (None, None), (5, "a")]
    pages = spark.createDataFrame([(p, "http://h/", h) for p, h in given], "page_id long, url string, html string")
    files = warc.write(pages)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(files).collect()), key=repr)
    want = []
    for p, h in given:
        data = (h or "").encode()
        revisit = h == big and p != 7
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert got == sorted(want, key=repr)
    ids = [fields["WARC-Record-ID"] for f in files.collect() for fields, _ in warc.Bundle(f["uri"]).records()]
    assert len(set(ids)) == len(given)
    some = sorted(((r["page_id"], r["payload_bytes"]) for r in warc.read(files, [5, 3, 99]).collect()), key=repr)
    assert some == sorted(((p, len((h or "").encode())) for p, h in given if p in (5, 3)), key=repr)
    assert warc.read(files, []).count() == 0


def test_a_file_that_is_there_already_stays_whole(tmp_path, monkeypatch):
    from pyarrow import fs

    from sluice.llm import common

    uri = f"file://{tmp_path}/x/f"
    common.put_file(uri, [b"whole"])

    class Refusing:
        def __init__(self):
            self.own = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.own, name)

        def move(self, a, b):
            raise OSError("exists")

    monkeypatch.setattr(common, "file_system", lambda u: (Refusing(), str(tmp_path / "x/f")))
    common.put_file(uri, [b"whole"])
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["f"] and (tmp_path / "x/f").read_bytes() == b"whole"
