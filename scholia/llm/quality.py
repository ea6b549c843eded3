"""Quality classifier: a byte-level convolutional network in numpy.

Input: the bytes of the whole text in overlapping chunks. Each byte has a learned embedding and, beside it, one channel for each
short lag that says whether the byte equals the one that lag earlier (repetition is the same at any alphabet). Learned filters
run over each chunk; their rectified responses are max-pooled over the chunk, and the document's features are the largest and
the mean of its chunks' pools, which a logistic layer combines into one probability.

Training takes a bounded sample of rows: at most ``each`` labelled documents of either label, whole, so it pools over all chunks
as scoring does. It runs in numpy on the driver by Adam with a fixed seed, some chunks at a time. Scoring reads every byte.
A document that is labelled both ways counts as label 1.

Rows: a null or empty text is scored as one chunk of padding; texts of any length are scored chunk by chunk in bounded memory;
rows that repeat get equal scores; where no label of one kind can be learned from, all scores are the share of label 1 (0.5
without any); empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import held_out, sample_ids

CHUNK, OVERLAP, WIDTH, STRIDE, DIM, LAGS, FILTERS = 1024, 16, 8, 2, 6, 10, 24


def chunks_of(text: str | bytes | None) -> np.ndarray:
    """Overlapping chunks (rows of CHUNK bytes, zero-padded) that cover the text."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else (text or b"")
    step = CHUNK - OVERLAP
    n = max(1, -(-max(0, len(data) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class Network:
    """The weights and what is computed with them."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.filters = r.normal(0, 0.15, (WIDTH * (DIM + LAGS), FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Chunks as rows of WIDTH positions by channels, one row each STRIDE bytes."""
        n = len(chunks)
        x = np.empty((n, CHUNK, DIM + LAGS), np.float32)
        x[:, :, :DIM] = self.embed[chunks]
        x[:, :, DIM:] = 0
        for k in range(LAGS):
            lag = k + 2
            x[:, lag:, DIM + k] = (chunks[:, lag:] == chunks[:, :-lag]) & (chunks[:, lag:] > 0)
        at = np.lib.stride_tricks.sliding_window_view(x.reshape(n, -1), WIDTH * (DIM + LAGS), axis=1)[:, :: STRIDE * (DIM + LAGS)]
        return np.ascontiguousarray(at)

    def inputs(self, chunks: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The channels at some positions (chunk, filter, position) only."""
        row = np.arange(len(chunks))[:, None, None]
        own = chunks[row, where]
        lagged = where[..., None] - np.arange(2, LAGS + 2)
        same = (chunks[row[..., None], np.maximum(lagged, 0)] == own[..., None]) & (lagged >= 0) & (own > 0)[..., None]
        return np.concatenate([self.embed[own], same.astype(np.float32)], axis=3)

    def pool(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's largest response of every filter, and where it was."""
        w = self.windows(chunks)
        z = (w.reshape(-1, w.shape[2]) @ self.filters).reshape(len(chunks), -1, FILTERS)
        best = z.argmax(axis=1)
        top = np.take_along_axis(z, best[:, None, :], axis=1)[:, 0] + self.bias
        return np.maximum(top, 0), best

    def pools(self, chunks: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pool(chunks[i : i + 32])[0] for i in range(0, len(chunks), 32)])

    def combine(self, largest: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.concatenate([largest, mean], axis=1) @ self.out + self.shift, -30, 30)))


def gradients(net: Network, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, part: int = 32) -> list[np.ndarray]:
    """Of the mean weighted cross-entropy of the documents (each its chunks) by every weight; ``part`` chunks at a time."""
    counts = [len(d) for d in docs]
    chunks = np.concatenate(docs)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int)
    owner = np.repeat(np.arange(len(docs)), counts)
    pooled, best = (np.concatenate(x) for x in zip(*(net.pool(chunks[i : i + part]) for i in range(0, len(chunks), part)), strict=True))
    largest = np.maximum.reduceat(pooled, starts, axis=0)
    avg = np.add.reduceat(pooled, starts, axis=0) / np.asarray(counts, np.float32)[:, None]
    g = ((net.combine(largest, avg) - y) * weight / len(docs)).astype(np.float32)
    features = np.concatenate([largest, avg], axis=1)
    d_features = g[:, None] * net.out
    d_pool = (d_features[:, FILTERS:] / np.asarray(counts, np.float32)[:, None])[owner]
    # of equal largest pools the first gets the gradient
    peak = np.zeros((len(docs), FILTERS), int)
    for i, (s, n) in enumerate(zip(starts.tolist(), counts, strict=True)):
        peak[i] = s + pooled[s : s + n].argmax(axis=0)
    np.add.at(d_pool, (peak, np.arange(FILTERS)), d_features[:, :FILTERS])
    d_pool *= pooled > 0
    d_embed, d_filters = np.zeros_like(net.embed), np.zeros_like(net.filters)
    for i in range(0, len(chunks), part):
        some, d, at = chunks[i : i + part], d_pool[i : i + part], best[i : i + part]
        where = at[:, :, None] * STRIDE + np.arange(WIDTH)
        d_filters += np.einsum("cf,cfk->kf", d, net.inputs(some, where).reshape(len(some), FILTERS, -1))
        back = (d[:, :, None] * net.filters.T).reshape(len(some), FILTERS, WIDTH, DIM + LAGS)[..., :DIM]
        np.add.at(d_embed, some[np.arange(len(some))[:, None, None], where], back)
    return [d_embed, d_filters, d_pool.sum(0), features.T @ g, np.array([g.sum()], np.float32)]


def train(texts: list[str | None], labels: list[int], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 0) -> Network:
    """The network fitted to the whole texts and labels (0 or 1), both kinds weighing the same."""
    net, r = Network(seed), np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    docs = [chunks_of(t) for t in texts]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    mean = [np.zeros_like(w) for w in net.weights()]
    power = [np.zeros_like(w) for w in net.weights()]
    step, steps = 0, epochs * -(-len(docs) // batch)
    for _ in range(epochs):
        order = r.permutation(len(docs))
        for at in range(0, len(docs), batch):
            ids = order[at : at + batch]
            grads = gradients(net, [docs[i] for i in ids], y[ids], weight[ids])
            grads[1] += 1e-4 * net.filters
            grads[3] += 1e-3 * net.out
            step += 1
            lr = rate * min(1, 3 * (1 - step / (steps + 1)))
            for w, d, m, v in zip(net.weights(), grads, mean, power, strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                w -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def score(net: Network, texts: list[str | bytes | None]) -> np.ndarray:
    """Each text's probability of label 1."""
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        pools = net.pools(chunks_of(t))
        out[i] = net.combine(pools.max(0)[None], pools.mean(0)[None])[0]
    return out


def learn(docs: DataFrame, labels: DataFrame, each: int = 1500, by: str = "quality") -> Network | float:
    """A network from at most ``each`` documents of either label among those not held out, or the share of label 1."""
    known = labels.select("doc_id", F.col(by).cast("int").alias("y")).where("y in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = sample_ids(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "y", each)
    # at most 2 * each rows of two numbers are broadcast, and their whole texts brought here
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")).collect()
    rows = sorted({(r["doc_id"], r["y"], r["text"]) for r in rows})
    y = [r[1] for r in rows]
    if len(set(y)) < 2:
        return float(y[0]) if y else 0.5
    return train([r[2] for r in rows], y)


def classify(docs: DataFrame, model: Network | float, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    if isinstance(model, float):
        scored = docs.select("doc_id", F.lit(model).alias("score"))
    else:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = score(model, [t.as_py() for t in b.column("text")])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], ["doc_id", "score"])

        scored = docs.select("doc_id", "text").mapInArrow(each, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Network | float, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; no shuffle."""
    if isinstance(model, float):
        return docs if model >= threshold else docs.limit(0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score(model, [t.as_py() for t in b.column("text")]) >= threshold))

    return docs.mapInArrow(each, docs.schema)
