"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words over its whole text. Each
passage is encoded from its bytes (byte histogram and word-repetition shares
through a learned tanh layer). A gate, ``w . (tanh(V h) * sigmoid(U h))``,
gives each passage a weight by softmax within the document; the weighted mean
of the passage codes goes through a logistic output. All layers are learned
together from document labels alone, so the attention finds which passages
decide.

The model is fitted by numpy on a bounded sample of labelled documents
(``max_docs`` documents in hash order and at most ``max_passages`` passages);
scoring is one pass over the text without a shuffle.

Defined cases: a null or empty text is one empty passage and gets a score;
documents without a label, null labels and null ids only get scores; several
labels of one document count as their majority (ties as 1); without any
labelled document every score is 0.5, with one class only it is near that
class; extra columns are left alone.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemstats.llm.common import fold, remove, small_batches, text_bytes, written

PASSAGE = 64
SHAPES = 6
WIDTH = 256 + SHAPES
Model = dict[str, np.ndarray]


def passages(data: bytes, size: int = PASSAGE) -> np.ndarray:
    """A row of features for each passage; one row for an empty text."""
    words = data.split()
    out = np.zeros((max(1, -(-len(words) // size)), WIDTH), np.float32)
    for i in range(0, len(words), size):
        own = words[i:i + size]
        joined, n = b" ".join(own), len(own)
        row = out[i // size]
        row[:256] = np.bincount(np.frombuffer(joined, np.uint8), minlength=256) / len(joined)
        same = sum(map(bytes.__eq__, own, own[1:]))
        row[256:] = (len(set(own)) / n, same / n, len(joined) / n / 8, n / size, len(set(map(len, own))) / n, 1.0)
    return out


def _softmax(a: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> np.ndarray:
    e = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    return e / np.add.reduceat(e, starts)[bag]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(m: Model, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of bags of n passages each, and what the gradient needs."""
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    bag = np.repeat(np.arange(len(n)), n)
    xs = (x - m["mean"]) * m["scale"]
    h = np.tanh(xs @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    a = _softmax((t * s) @ m["w"], starts, bag)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return z @ m["c"] + m["c0"][0], (starts, bag, xs, h, t, s, a, z)


def gradient(m: Model, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> Model:
    logit, (_, bag, xs, h, t, s, a, z) = forward(m, x, n)
    d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    dz = d[:, None] * m["c"]
    da = (dz[bag] * h).sum(1)
    per_bag = np.zeros(len(n), np.float32)
    np.add.at(per_bag, bag, a * da)
    ds = a * (da - per_bag[bag])
    dt, dg = ds[:, None] * m["w"] * s * (1 - t * t), ds[:, None] * m["w"] * t * s * (1 - s)
    dh = a[:, None] * dz[bag] + dt @ m["V"].T + dg @ m["U"].T
    dx = dh * (1 - h * h)
    return {"W": xs.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * s).T @ ds,
            "c": z.T @ d, "c0": d.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, width: int = 32, gate: int = 16, epochs: int = 30,
          batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 1) -> Model:
    """Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    n_all, total, squares = 1e-9, np.zeros(WIDTH), np.zeros(WIDTH)
    for b in bags:
        wide = b.astype(np.float64)
        n_all, total, squares = n_all + len(b), total + wide.sum(0), squares + (wide * wide).sum(0)
    mean = total / n_all
    spread = np.sqrt(np.maximum(squares / n_all - mean * mean, 0))
    start = {"W": (WIDTH, width), "b": (width,), "V": (width, gate), "U": (width, gate), "w": (gate,), "c": (width,), "c0": (1,)}
    m: Model = {k: (rng.standard_normal(s) / np.sqrt(s[0]) * (len(s) > 1 or k == "w")).astype(np.float32) for k, s in start.items()}
    # rare bytes keep a floor, so that an unseen one can't swamp the rest
    m |= {"mean": mean.astype(np.float32), "scale": (1 / np.maximum(spread, 0.01)).astype(np.float32)}
    first = {k: np.zeros_like(m[k]) for k in start}
    second = {k: np.zeros_like(m[k]) for k in start}
    step = 0
    for _ in range(epochs if len(bags) else 0):
        for own in np.array_split(rng.permutation(len(bags)), -(-len(bags) // batch)):
            step += 1
            x, n = np.concatenate([bags[i] for i in own]).astype(np.float32), np.array([len(bags[i]) for i in own])
            for k, g in gradient(m, x, n, labels[own]).items():
                g = g + decay * m[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                m[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return m


def _features(most: int):
    """At most so many of a text's passages, spread over its length."""

    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            x = passages(t.as_py())
            if len(x) > most:
                x = x[np.linspace(0, len(x) - 1, most).astype(np.int64)]
            out.append(x.astype(np.float16).tobytes())
        return pa.array(out, pa.binary())

    return features


def _trained(**params):
    """Over the whole sample: its model, as one row."""

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            xs += [np.frombuffer(x.as_buffer(), np.float16).reshape(-1, WIDTH) for x in batch.column("x")]
            ys += batch.column("label").to_pylist()
        out = io.BytesIO()
        np.savez(out, **train(xs, np.array(ys, np.float32), **params))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    return trained


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, max_passages: int = 120_000, **params) -> Model:
    """``labels`` has doc_id and label (0 or 1); only its rows are learned from.
    The sample is ``max_docs`` labelled documents in hash order, each with at
    most ``max_passages / max_docs`` passages spread over its length, so a long
    text takes no other's place. One task trains on it and returns the weights."""
    small_batches(docs.sparkSession)
    drawn = (labels.filter("doc_id is not null and label is not null").groupBy("doc_id")
             .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    # at most max_docs narrow rows are broadcast
    bags = written(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
                   .select("doc_id", "label", _features(max(1, max_passages // max_docs))(text_bytes()).alias("x")), "bags")
    # of repeated ids, so many rows as documents were drawn
    sample = bags.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(max_docs)
    row = (sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x"))
           .select("label", "x").mapInArrow(_trained(**params), "model binary").first())
    remove(bags)
    return dict(np.load(io.BytesIO(row["model"]))) if row else train([], np.empty(0, np.float32), **params)


def score(model: Model, text: str = "text", at_once: int = 4096) -> Column:
    """0 to 1, higher: label 1 is likelier."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out, held, n = [], [], 0

        def flush() -> None:
            logit, _ = forward(model, np.concatenate(held), np.array([len(x) for x in held]))
            out.append(1 / (1 + np.exp(-logit.astype(np.float64))))

        for t in texts:
            held.append(passages(t.as_py()))
            n += len(held[-1])
            if n > at_once:
                flush()
                held, n = [], 0
        if held:
            flush()
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return scored(text_bytes(text))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **params) -> DataFrame:
    """docs with held_out, score and predicted; learned from the folds of
    ``labels(doc_id, label)`` that aren't held out (crc32 of the id modulo 4
    is 2)."""
    model = fit(docs, labels.filter(fold("doc_id", 4) != 2), **params)
    return (docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score(model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **params) -> DataFrame:
    """The rows of docs whose score reaches the threshold, as they are."""
    model = fit(docs, labels.filter(fold("doc_id", 4) != 2), **params)
    return docs.filter(score(model) >= threshold)
