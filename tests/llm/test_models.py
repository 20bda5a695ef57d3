"""The learned scores: held-out accuracy, awkward texts, and the rules of learning."""

import zlib

import numpy as np
import pytest

from sluice.llm import quality_cnn, toxicity
from tests.llm.helpers import clashing, documents

ODD = [None, "", " ", "é" * 3000, "x" * 200000, "퟿", "idiot"]


def labels(spark, values, column):
    return spark.createDataFrame(list(enumerate(values)), f"doc_id long, {column} int")


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(300)]
    texts, y = [], []
    for k in range(400):
        own = list(rng.choice(words, 60))
        y.append(int(k % 5 == 0))
        if y[-1]:
            own[10] = "Moron"
            own[40] = f"vile{rng.integers(0, 40)}st"
        texts.append(" ".join(own) + ".")
    docs = clashing(documents(spark, texts))
    return docs, labels(spark, y, "toxic"), y


def test_toxicity(spark, toxic):
    docs, lab, y = toxic
    model = toxicity.train(docs, lab)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for k in range(len(y)):
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= got[k]["score"] <= 1
    held = [k for k in got if got[k]["held_out"]]
    assert np.mean([got[k]["predicted"] == y[k] for k in held]) > 0.95
    kept = toxicity.without_toxic(docs, lab)
    assert kept.columns == docs.columns and abs(kept.count() - (len(y) - sum(y))) < 10
    odd = toxicity.score(documents(spark, ODD, ids=[None, *range(1, len(ODD))]), model).collect()
    assert len(odd) == len(ODD) and all(r["score"] is not None for r in odd)


def test_held_out_labels_change_nothing(spark, toxic):
    docs, lab, y = toxic
    flipped = labels(spark, [1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v for k, v in enumerate(y)], "toxic")
    a, b = toxicity.train(docs, lab), toxicity.train(docs, flipped)
    assert a.lexicon.words == b.lexicon.words and np.allclose(a.fit[0], b.fit[0])


def test_grammar():
    reader = toxicity.Reader(toxicity.Lexicon({"moron": 2.0}, {"vile": 1.0}))
    weight = lambda t: sum(reader.clauses(t)[0])
    assert weight("a moron came.") == 2.0 and weight("nothing here.") == 0
    assert weight("you are a moron.") > weight("a moron came.") > weight("report said a moron came.") > 0
    assert weight("not a moron.") < weight("a moron.")
    assert weight("i will kill you.") > 0 and weight("i will kill time.") == 0
    assert weight("said it. a moron came.") == 2.0 and weight("the vilest.") == 1.0
    assert len(reader.clauses("moron. moron! fine. moron")[0]) == 3


def plain_paths(words):
    """The relations by looking around each word of a clause; words are (class, weight)."""
    own = [0.0] * 5
    for i, (kind, weight) in enumerate(words):
        kinds = [k for k, _ in words]
        if kind == toxicity.INSULT:
            near = toxicity.TARGET in kinds[max(0, i - 3) : i] + kinds[i + 1 : i + 4]
            negated, reported = toxicity.NEGATION in kinds[max(0, i - 2) : i], toxicity.REPORT in kinds[:i]
            path = 3 if reported else 2 if negated else 1 if near else 0
            own[path] += weight * (1.5 if near else 1) * (0.5 if negated else 1) * (0.7 if reported else 1)
        if kind == toxicity.TARGET:
            before = [j for j in range(max(0, i - 3), i) if kinds[j] == toxicity.THREAT]
            own[4] += 2.0 if before and toxicity.TARGET not in kinds[before[-1] + 1 : i] else 0.0
    return own


def test_composed_transducers_equal_a_plain_reading():
    import random

    rng = random.Random(8)
    lexicon = toxicity.Lexicon({"moron": 2.0, "idiot": 1.5}, {})
    reader = toxicity.Reader(lexicon)
    words = ["moron", "idiot", "kill", "you", "him", "not", "said", "the", "a", "of"]
    for _ in range(500):
        clauses = [[rng.choice(words) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 4))]
        text = "".join(" ".join(c) + rng.choice([". ", ", ", "\n", "! "]) for c in clauses)
        want = [p for c in clauses if any(p := plain_paths([lexicon.look(w) for w in c]))]
        got = reader.paths(text)[0]
        assert len(got) == len(want) and all(np.allclose(g, w) for g, w in zip(got, want)), text


def test_each_relation_decides(spark, monkeypatch):
    """Insults are in most of the toxic and in some of the other documents; how they are used tells. Without a relation's transducer held-out predictions differ."""
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    toxic = ["you are a moron", "a moron like him", "you moron", "we will kill you"]
    clean = ["you are no moron", "he said you are a moron", "a moron came", "we kill time"]
    texts, y = [], []
    for k in range(3000):
        y.append(int(k % 4 == 0))
        used = str(rng.choice(toxic) if y[-1] else rng.choice(clean) if rng.random() < 0.14 else "we know it will be like this")
        own = [" ".join(rng.choice(words, rng.integers(6, 18))) for _ in range(4)]
        texts.append(f"{own[0]}. {own[1]}.\n{used}, {own[2]}. {own[3]}.")
    docs, lab = documents(spark, texts), labels(spark, y, "toxic")
    held = [k for k in range(len(y)) if zlib.crc32(str(k).encode()) % 5 == 0]

    def predicted():
        model = toxicity.train(docs, lab)
        return model.scores(toxicity.Reader(model.lexicon), [texts[k] for k in held]) >= 0.5

    whole, grammar, backwards = predicted(), toxicity.GRAMMAR, toxicity.BACKWARDS
    truth = np.array([y[k] for k in held]) == 1
    assert (whole == truth).mean() > 0.97
    for part in grammar:
        monkeypatch.setattr(toxicity, "GRAMMAR", tuple(t for t in grammar if t is not part))
        monkeypatch.setattr(toxicity, "BACKWARDS", tuple(t for t in backwards if t is not part))
        less = predicted()
        assert (less != whole).any() and (less == truth).mean() < (whole == truth).mean(), grammar.index(part)


def test_every_word_of_a_token_is_read():
    reader = toxicity.Reader(toxicity.Lexicon({"idiot": 2.0}, {}))
    weight = lambda t: sum(reader.clauses(t)[0])
    for t in ("some/idiot", "well...idiot", "<b>idiot", "stupid-idiot", "<b>some</b>idiot", "...idiot", "x" * 100 + "/idiot"):
        assert weight(t) == 2.0, t
    # Marks between words end clauses inside a token, before it and after it; those of numbers don't.
    assert weight("you.idiot") == weight("you ...idiot") == weight("you. idiot") == 2.0
    assert weight("you/idiot") == weight("you 3.5 idiot") == weight("you idiot") > 2.0
    assert weight("not-an-idiot") == weight("not an idiot") < 2.0
    assert len(reader.clauses("idiot.idiot!idiot")[0]) == 3 and len(reader.clauses("an idiot ...an idiot")[0]) == 2
    text = "a/b <i>c</i> d-e.f 12 -- g's'h"
    assert reader.clauses(text)[1] == len(toxicity.WORD.findall(text)) + 2


def test_quality(spark):
    rng = np.random.default_rng(2)
    letters = list("etaoinshrdlu")
    word = lambda: "".join(rng.choice(letters, rng.integers(2, 8)))
    texts, y = [], []
    for k in range(400):
        own = [word() for _ in range(rng.integers(20, 200))]
        y.append(int(k % 4 != 0))
        texts.append(" ".join(own if y[-1] else [w + "###" for w in own]))
    docs, lab = clashing(documents(spark, texts)), labels(spark, y, "quality")
    model = quality_cnn.train(docs, lab)
    got = {r["doc_id"]: r for r in quality_cnn.score(docs, model).collect()}
    held = [k for k in got if got[k]["held_out"]]
    assert np.mean([got[k]["predicted"] == y[k] for k in held]) > 0.95
    odd = quality_cnn.score(documents(spark, ODD), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd)
    # The whole document counts: junk behind two thousand good words is seen.
    good = " ".join(word() for _ in range(2000))
    a, b = model.scores([good, good + " ###" * 6000])
    assert a > b
    # Batches don't change scores, whatever their texts.
    assert np.allclose(model.scores(ODD + texts[:5]), np.concatenate([model.scores([t]) for t in ODD + texts[:5]]), atol=1e-5)


def test_quality_learns_no_held_out_label(spark):
    texts = [("good words " if k % 3 else "### $$$ ") * 30 + str(k) for k in range(120)]
    y = [int(k % 3 > 0) for k in range(120)]
    flipped = [1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v for k, v in enumerate(y)]
    a, b = (quality_cnn.train(documents(spark, texts), labels(spark, v, "quality")).scores(texts) for v in (y, flipped))
    assert (a == b).all()


def test_convolution_equals_a_naive_one():
    """Each filter at each place of each chunk, one product at a time."""
    rng = np.random.default_rng(5)
    q, d = quality_cnn, quality_cnn.D
    net = q.Network(*(rng.normal(0, 0.5, s).astype(np.float32) for s in ((256, d), (2, 4 * d, q.FILTERS), (q.FILTERS,), (q.FILTERS + 2, q.HIDDEN), (q.HIDDEN,), (q.HIDDEN,))), 0.25)
    texts = [b"", b"short", bytes(rng.integers(0, 256, 1500, dtype=np.uint8)), "é".encode() * 700, b"x" * 512]
    model = q.Model(net, None, 0.0)
    data, chunks = q.laid_out(texts)
    got = model.chunk_logits(data, chunks)
    want = []
    for t, n in zip(texts, chunks):
        for c in range(n):
            own = t[c * q.STEP : (c + 1) * q.STEP + q.CELL].ljust(q.STEP + q.CELL, b"\0")
            best = np.full(q.FILTERS, -np.inf)
            for at in range(0, q.STEP + q.CELL - 7, 4):
                window = np.concatenate([net.bytes_[b] for b in own[at : at + 8]]).astype(np.float64)
                best = np.maximum(best, window @ np.concatenate([net.filters[0], net.filters[1]]))
            grams = [own[i : i + 4] for i in range(q.STEP - 3)]
            real = [g for g in grams if g != bytes(4)]
            again = (len(real) - len(set(real))) / max(1, len(real))
            z = np.concatenate([np.maximum(best + net.bias, 0), [again, own[: q.STEP].count(0) / q.STEP]])
            want.append(np.tanh(z @ net.w1 + net.b1) @ net.w2 + net.b2)
    assert np.allclose(got, want, atol=1e-3)


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality_cnn, "quality")])
def test_without_labels(spark, module, column):
    docs = documents(spark, ["a", None])
    none = labels(spark, [None, 1], column)
    model = module.train(docs, none.limit(0))
    assert module.score(docs, model).count() == 2 and module.score(docs.limit(0), model).count() == 0
    assert module.score(docs, module.train(docs, none)).count() == 2
