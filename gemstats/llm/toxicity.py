"""Toxicity grades by cumulative-link ordinal regression.

A text's features are its distinct words (runs of ASCII letters and non-ASCII
bytes, A-Z in lower case), hashed to ``2**BITS`` places, each counting 1. All
ordered thresholds share the weights: ``P(grade > k) = sigmoid(w.x - t_k)``
with ``t_0 < t_1 < ...`` kept apart by a softplus step. The expected severity
is ``sum over k of P(grade > k)``.

The model is fitted in numpy on a bounded sample of graded documents
(``max_docs`` in hash order, at most ``max_features`` features); words in
fewer than ``least_docs`` of them, or that don't go with the grade, get no
weight. Scoring is one pass without a
shuffle.

``graded`` makes grades from yes/no labels: 0 for no, and for yes 1, 2 or 3 by
thirds of how many distinct telling words (those that are far commoner in
documents labelled yes) a document has, so that the grades are ordered by
how much of what makes a document toxic it holds.

Defined cases: null and empty texts have no features and get the severity of
the thresholds alone; ungraded documents, null grades and null ids only get
scores; several grades of one document count as the highest; without any
graded document severity is 0; other columns are left alone.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gemstats.llm.common import fold, small_batches, text_bytes, written

BITS = 18
WORDS = re.compile(rb"[a-z\x80-\xff]+")
Model = dict[str, np.ndarray]


def features(data: bytes) -> np.ndarray:
    """The places of a text's distinct words, sorted."""
    crc, mask = zlib.crc32, (1 << BITS) - 1
    return np.unique(np.array([crc(w) & mask for w in set(WORDS.findall(data.lower()))], np.int32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def thresholds(m: Model) -> np.ndarray:
    """The first threshold, and steps above 0 to the others."""
    return np.cumsum(np.concatenate([m["t"][:1], np.log1p(np.exp(m["t"][1:]))]))


def _sums(m: Model, places: np.ndarray, n: np.ndarray) -> np.ndarray:
    own = np.concatenate([[0.0], np.cumsum(m["w"][places])])
    ends = np.cumsum(n)
    return own[ends] - own[ends - n]


def above(m: Model, places: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(grade > k) for each text of n places and each threshold k."""
    return sigmoid(_sums(m, places, n)[:, None] - thresholds(m))


def gradient(m: Model, places: np.ndarray, n: np.ndarray, grade: np.ndarray) -> Model:
    """Of the mean of -log P(grade) where P(grade) is the difference of
    neighbouring thresholds' probabilities."""
    p = above(m, places, n)
    edge = np.hstack([np.ones((len(n), 1)), p, np.zeros((len(n), 1))])
    own = np.arange(len(n))
    mass = np.maximum(edge[own, grade] - edge[own, grade + 1], 1e-9)
    slope = edge * (1 - edge)
    upper, lower = -slope[own, grade] / mass / len(n), slope[own, grade + 1] / mass / len(n)
    dt = np.zeros(p.shape[1] + 2)
    np.add.at(dt, grade, -upper)
    np.add.at(dt, grade + 1, -lower)
    tail = np.cumsum(dt[1:-1][::-1])[::-1]
    return {"w": np.bincount(places, weights=np.repeat(upper + lower, n), minlength=len(m["w"])),
            "t": np.concatenate([tail[:1], tail[1:] * sigmoid(m["t"][1:])])}


def train(texts: list[np.ndarray], grades: np.ndarray, levels: int, least_docs: int = 5, least_z: float = 4.0,
          steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Adam on all texts at once, over the words that go with the grade: those
    whose documents' mean grade is ``least_z`` standard errors off the mean."""
    places = np.concatenate(texts) if texts else np.empty(0, np.int32)
    n = np.array([len(t) for t in texts], np.int64)
    docs = np.bincount(places, minlength=1 << BITS)
    if len(grades):
        off = np.bincount(places, weights=np.repeat(grades - grades.mean(), n), minlength=1 << BITS)
        docs = np.where(np.abs(off) >= least_z * np.sqrt(docs * (grades.var() + 1e-9)), docs, 0)
    keep = docs[places] >= least_docs
    n = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
    places = places[keep]
    # log-odds of the shares above each threshold: what an empty text gets at first
    share = np.array([(np.sum(grades > k) + 0.5) / (len(grades) + 1) for k in range(levels - 1)])
    first = -np.log(share / (1 - share)) if len(grades) else np.full(levels - 1, 9.0)
    steps_up = np.maximum(np.diff(first), 1e-3)
    m = {"w": np.zeros(1 << BITS), "t": np.concatenate([first[:1], np.log(np.expm1(steps_up))])}
    one, two = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for step in range(1, (steps if len(grades) else 0) + 1):
        g = gradient(m, places, n, grades)
        g["w"] += decay * m["w"]
        for k, v in g.items():
            one[k] = 0.9 * one[k] + 0.1 * v
            two[k] = 0.99 * two[k] + 0.01 * v * v
            m[k] = m[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)
    return m


def _places():
    @F.arrow_udf("binary")
    def places(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()).tobytes() for t in texts], pa.binary())

    return places


def sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_features: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the labelled documents the model may see."""
    small_batches(docs.sparkSession)
    drawn = (labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    # at most max_docs narrow rows are broadcast
    rows = written(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
                   .select("doc_id", "label", _places()(text_bytes()).alias("x")), "graded")
    running = F.sum(F.octet_length("x")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")))
    got = rows.withColumn("total", running).filter(F.col("total") <= 4 * max_features).orderBy("total").select("label", "x").toArrow()
    return [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("x")], got.column("label").to_numpy().astype(np.int64)


def graded(texts: list[np.ndarray], yes: np.ndarray, levels: int = 4, least_docs: int = 5, lift: float = 20.0) -> np.ndarray:
    """Grades 0 to levels-1 from yes/no labels by the number of telling words."""
    if not len(yes):
        return yes
    places, n = np.concatenate(texts), np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(n)), n)
    in_yes = np.bincount(places, weights=yes[owner] > 0, minlength=1 << BITS)
    in_no = np.bincount(places, weights=yes[owner] == 0, minlength=1 << BITS)
    telling = (in_yes >= least_docs) & (in_yes / max(1, (yes > 0).sum()) > lift * (in_no + 0.5) / max(1, (yes == 0).sum()))
    hits = np.bincount(owner, weights=telling[places], minlength=len(n))
    cuts = np.quantile(hits[yes > 0], np.arange(1, levels - 1) / (levels - 1)) if (yes > 0).any() else []
    return np.where(yes > 0, 1 + np.searchsorted(cuts, hits, "left"), 0).astype(np.int64)


def score(m: Model, text: str = "text", at_once: int = 1 << 20) -> Column:
    """P(grade > k) for each threshold, as an array."""

    @F.arrow_udf("array<double>")
    def scored(texts: pa.Array) -> pa.Array:
        out, held, size = [np.empty((0, len(m["t"])))], [], 0
        for t in texts:
            held.append(features(t.as_py()))
            size += len(held[-1])
            if size > at_once:
                out.append(above(m, np.concatenate(held), np.array([len(x) for x in held])))
                held, size = [], 0
        if held:
            out.append(above(m, np.concatenate(held), np.array([len(x) for x in held])))
        p = np.concatenate(out)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))

    return scored(text_bytes(text))


def fit(docs: DataFrame, labels: DataFrame, levels: int | None = None, max_docs: int = 20_000, max_features: int = 10_000_000) -> Model:
    """From ``labels(doc_id, label)``: grades 0 to levels-1, or yes/no labels
    that ``graded`` refines (levels None)."""
    texts, label = sample(docs, labels, max_docs, max_features)
    if levels is None:
        return train(texts, graded(texts, label), 4)
    return train(texts, np.clip(label, 0, levels - 1), levels)


def severity(docs: DataFrame, labels: DataFrame, levels: int | None = None, toxic_at: float = 0.5, **params) -> DataFrame:
    """doc_id, held_out, score (P of any grade above 0), expected_severity,
    severity (the likeliest grade) and toxic (score >= toxic_at) of each row.
    Learns from ids whose crc32 modulo 4 is not 2."""
    m = fit(docs, labels.filter(fold("doc_id", 4) != 2), levels, **params)
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score(m).alias("p"))
    k = len(m["t"])
    mass = F.expr(f"transform(sequence(0, {k}), i -> if(i = 0, 1D, p[i - 1]) - if(i = {k}, 0D, p[i]))")
    return rows.select("doc_id", "held_out", F.col("p")[0].alias("score"), F.expr("aggregate(p, 0D, (a, x) -> a + x)").alias("expected_severity"),
                       (F.array_position(mass, F.array_max(mass)) - 1).cast("int").alias("severity"),
                       (F.col("p")[0] >= toxic_at).alias("toxic"))
