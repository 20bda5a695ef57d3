"""Quality by a byte-level convolutional network in numpy.

Learned filters, eight bytes wide at every fourth byte, run over the whole text.
Their responses are max-pooled over overlapping chunks, and a small layer gives each
chunk a logit; one more input of that layer is how often the chunk's four-byte
strings repeat, which no filter of fixed strings can tell. A logistic regression
combines the logits of all chunks of a document into one probability.

Filters, byte vectors and layers are fitted by gradient descent on a bounded sample
of labelled documents. Scoring is matrix products over batches of whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import held_out, labelled_sample, logistic

#: Most labelled documents that the network is fitted on, with all their chunks; a document weighs as much as any other.
SAMPLE = 3000
#: Dimensions of a byte, filters, hidden units.
D, FILTERS, HIDDEN = 8, 32, 16
#: A chunk is 512 bytes and the first 64 of the next one.
STEP, CELL = 512, 64
CELLS = STEP // CELL
EPOCHS, BATCH, RATE = 6, 256, 4e-3
#: Bytes that are scored at a time.
GROUP = 1 << 20


def laid_out(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each filled up with zeros to whole chunks and one cell more at the end of all; chunks of each). An empty text is one chunk."""
    texts = list(texts)
    chunks = np.array([max(1, -(-len(t) // STEP)) for t in texts], np.int64)
    data = b"".join(t.ljust(int(n) * STEP, b"\0") for t, n in zip(texts, chunks, strict=True))
    return np.frombuffer(data + bytes(CELL), np.uint8), chunks


@dataclass
class Network:
    bytes_: np.ndarray  # 256 x D
    filters: np.ndarray  # 2 halves x 4 D x FILTERS
    bias: np.ndarray
    w1: np.ndarray  # FILTERS + 2 x HIDDEN
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def pooled(self, data: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each chunk; last marks the chunks after which another text starts."""
        x = self.bytes_[data].reshape(-1, 4 * D)
        u, v = x @ self.filters[0], x @ self.filters[1]
        # A text ends in zeros, whatever comes after it here.
        nothing = np.tile(self.bytes_[0], 4)
        end = nothing @ self.filters[1]
        u[:-1] += v[1:]
        stop = (np.flatnonzero(last) + 1) * (STEP // 4) - 1
        u[stop] += end - v[stop + 1]
        cells = u.reshape(-1, CELL // 4, FILTERS)
        own = cells[: len(last) * CELLS].max(axis=1).reshape(-1, CELLS, FILTERS).max(axis=1)
        # The next chunk's first cell, but for the window that leaves it.
        more = cells[CELLS::CELLS, :-1].max(axis=1)
        more[last] = nothing @ self.filters[0] + end
        return np.maximum(own, more) + self.bias

    def logits(self, pooled: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        h = np.tanh(np.column_stack([np.maximum(pooled, 0), repeats]).astype(np.float32) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2


def repeats(data: np.ndarray, chunks: int) -> np.ndarray:
    """Per chunk: the share of its four-byte strings that came before in it, and the share of bytes that are filling."""
    own = data[: chunks * STEP].reshape(chunks, STEP).astype(np.uint32)
    grams = own[:, :-3] | own[:, 1:-2] << np.uint32(8) | own[:, 2:-1] << np.uint32(16) | own[:, 3:] << np.uint32(24)
    grams.sort(axis=1)
    empty = (own == 0).mean(axis=1)
    same = ((grams[:, 1:] == grams[:, :-1]) & (grams[:, 1:] != 0)).sum(axis=1)
    return np.column_stack([same / np.maximum((grams != 0).sum(axis=1), 1), empty]).astype(np.float32)


def document_features(logits: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Mean, smallest and largest logit of each document's chunks, and the logarithm of their number."""
    starts = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    z = np.clip(logits, -12, 12).astype(np.float64)
    return np.column_stack([np.add.reduceat(z, starts) / chunks, np.minimum.reduceat(z, starts), np.maximum.reduceat(z, starts), np.log(chunks)])


@dataclass
class Model:
    network: Network | None
    fit: tuple | None
    prior: float

    def features(self, texts: list[bytes]) -> np.ndarray:
        out, at = [], 0
        while at < len(texts):
            # A group ends at GROUP bytes; longer texts are groups of their own.
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP):
                size += len(texts[end]) + STEP
                end += 1
            data, chunks = laid_out(texts[at:end])
            out.append(document_features(self.chunk_logits(data, chunks), chunks))
            at = end
        return np.concatenate(out) if out else np.empty((0, 4))

    def chunk_logits(self, data: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        n = int(chunks.sum())
        last = np.zeros(n, bool)
        last[np.cumsum(chunks) - 1] = True
        found, per = [], GROUP // STEP
        # Very long texts go through in parts; a chunk always sees the first cell of the next one.
        for a in range(0, n, per):
            b = min(n, a + per)
            part = data[a * STEP : b * STEP + CELL]
            found.append(self.network.logits(self.network.pooled(part, last[a:b]), repeats(part, b - a)))
        return np.concatenate(found)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        if self.network is None:
            return np.full(len(raw), self.prior)
        w, bias, mean, scale = self.fit
        return 1 / (1 + np.exp(-np.clip((self.features(raw) - mean) / scale @ w + bias, -30, 30)))


def fitted(chunks: np.ndarray, y: np.ndarray, share: np.ndarray, seed: int = 7) -> Network:
    """chunks: bytes, STEP + CELL of each; share: what each weighs. Adam on the logistic loss; the gradient passes through each filter's best window alone."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    p = {
        "e": rng.normal(0, 0.5, (256, D)).astype(f32),
        "f": rng.normal(0, 0.2, (2, 4 * D, FILTERS)).astype(f32),
        "c": np.zeros(FILTERS, f32),
        "w1": rng.normal(0, 0.2, (FILTERS + 2, HIDDEN)).astype(f32),
        "b1": np.zeros(HIDDEN, f32),
        "w2": rng.normal(0, 0.2, HIDDEN).astype(f32),
        "b2": np.zeros(1, f32),
    }
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    again = repeats(np.ascontiguousarray(chunks[:, :STEP]).reshape(-1), len(chunks))
    good = float((share * y).sum() / share.sum())
    balance = (np.where(y == 1, 0.5 / max(good, 1e-6), 0.5 / max(1 - good, 1e-6)) * share / share.mean()).astype(f32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), BATCH):
            i = order[at : at + BATCH]
            b, n = chunks[i], len(i)
            x = p["e"][b].reshape(n, -1, 4 * D)
            u, w = x @ p["f"][0], x @ p["f"][1]
            conv = u[:, :-1] + w[:, 1:]
            best = conv.argmax(axis=1)
            top = np.take_along_axis(conv, best[:, None], 1)[:, 0] + p["c"]
            z = np.column_stack([np.maximum(top, 0), again[i]]).astype(f32)
            h = np.tanh(z @ p["w1"] + p["b1"])
            logit = h @ p["w2"] + p["b2"]
            d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[i]) * balance[i] / n).astype(f32)
            g = {"w2": h.T @ d, "b2": d.sum(keepdims=True)}
            dh = d[:, None] * p["w2"] * (1 - h * h)
            g["w1"], g["b1"] = z.T @ dh, dh.sum(axis=0)
            dtop = (dh @ p["w1"].T)[:, :FILTERS] * (top > 0)
            g["c"] = dtop.sum(axis=0)
            windows = np.stack([np.take_along_axis(x, best[..., None], 1), np.take_along_axis(x, best[..., None] + 1, 1)])  # 2, n, FILTERS, 4 D
            g["f"] = np.einsum("snfd,nf->sdf", windows, dtop)
            places = best[..., None] * 4 + np.arange(8)
            own = np.take_along_axis(b, places.reshape(n, -1), 1).reshape(n, FILTERS, 8)
            de = np.einsum("nf,sdf->nfsd", dtop, p["f"]).reshape(n, FILTERS, 8, D)
            flat = own.reshape(-1).astype(np.int64)
            g["e"] = np.column_stack([np.bincount(flat, de[..., k].reshape(-1), 256) for k in range(D)]).astype(f32)
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(f32)
    return Network(p["e"], p["f"], p["c"], p["w1"], p["b1"], p["w2"], float(p["b2"][0]))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """From labelled documents that are not held out. Without documents of both labels every score is the share of good ones."""
    sample = labelled_sample(docs, labels, "quality", bound)
    y = np.array([r[2] for r in sample], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(None, None, float(y.mean()) if len(y) else 0.5)
    raw = [r[1].encode("utf-8", "surrogatepass") for r in sample]
    many = np.array([max(1, -(-len(t) // STEP)) for t in raw])
    of = np.repeat(np.arange(len(raw)), many)
    data, _ = laid_out(raw)
    rows = np.lib.stride_tricks.sliding_window_view(data, STEP + CELL)[::STEP].copy()
    # A document's last chunk ends in zeros, whatever comes after it here.
    rows[np.cumsum(many) - 1, STEP:] = 0
    model = Model(fitted(rows, y[of].astype(np.float32), 1 / many[of]), None, float(y.mean()))
    model.fit = logistic(model.features(raw), y)
    return model


def scorer(model: Model) -> Callable[[Column], Column]:
    """The score of a text column; only texts travel to the workers."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts))

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.3). Null and empty texts are scored as one empty chunk; a null id is not held out."""
    out = F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out")
    scored = docs.select(F.col(doc_id), out, scorer(model)(F.col(text)).alias("score"))
    return scored.select(doc_id, "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
