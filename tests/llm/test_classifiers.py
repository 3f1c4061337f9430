import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gemstats.llm import quality, toxicity

SAYS = "the of river stone and light morning walked under tall green trees by quiet water".split()


def text(rng, n, extra=()):
    return " ".join([rng.choice(SAYS) + str(rng.randrange(60)) if rng.random() < .5 else rng.choice(SAYS) for _ in range(n)] + list(extra))


def labelled(spark, bad, n=700, share=0.25):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        yes = rng.random() < share
        body = text(rng, rng.choice([3, 40, 300]))
        rows.append((i, bad(rng, body) if yes else body, "x", 3, 1.5))
        labels.append((i, int(yes)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int, p double"), labels


ODD = [(None, "null id"), (2001, None), (2002, ""), (2003, " \n"), (2004, "word " * 30000), (2005, "same"), (2005, "same"), (2006, "\x00 ÿ ✓")]


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_quality_on_held_out_documents(spark):
    df, labels = labelled(spark, lambda rng, t: t.upper().replace(" ", " #$ ") if rng.random() < .5 else " ".join(w for w in t.split() for _ in range(5)))
    odd = spark.createDataFrame([(d, t, "x", 3, 1.5) for d, t in ODD], df.schema)
    good = spark.createDataFrame([(i, 1 - y) for i, y in labels] + [(None, 1), (5, None), (99999, 0)], "doc_id long, label int")
    rows = quality.quality_scores(df.unionByName(odd), good).collect()
    assert len(rows) == df.count() + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= .7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 4) == 2) for r in rows)
    want = dict(labels)
    held = [(r.predicted, 1 - want[r.doc_id]) for r in rows if r.held_out and r.doc_id in want]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > .95
    kept = quality.keep_good(df, good)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted and r.doc_id in want}


def test_quality_without_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.quality_scores(df, none).collect()} == {0.5}
    assert quality.quality_scores(df.limit(0), none).collect() == []


def test_quality_gradient():
    rng = np.random.default_rng(0)
    m = quality.train([], np.empty(0), width=5, gate=3)
    m = {k: v.astype(np.float64) for k, v in m.items()} | {k: rng.normal(size=m[k].shape) for k in ("b", "c", "c0")}
    x, n, y = rng.random((7, quality.WIDTH)), np.array([2, 1, 4]), np.array([1.0, 0, 1])

    def loss(m):
        z = quality.forward(m, x, n)[0]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g = quality.gradient(m, x, n, y)
    for k in g:
        i = tuple(rng.integers(0, s) for s in m[k].shape)
        up, down = ({a: b.copy() for a, b in m.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert g[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=2e-2, abs=1e-6)


def test_attention_finds_the_deciding_passage():
    rng = random.Random(3)
    bags, y = [], []
    for i in range(400):
        words = text(rng, 64 * 6).encode().split()
        if i % 2:
            words[128:192] = [b"##$$%%"] * 64
        bags.append(quality.passages(b" ".join(words)))
        y.append(i % 2)
    m = quality.train(bags[:300], np.array(y[:300], np.float32))
    n = np.array([len(b) for b in bags[300:]])
    logit, (*_, a, _) = quality.forward(m, np.concatenate(bags[300:]), n)
    assert np.mean((logit > 0) == np.array(y[300:])) > .98
    weights = np.split(a, np.cumsum(n)[:-1])
    odd = [w for w, k in zip(weights, y[300:], strict=True) if k]
    assert np.mean([w[2] > 2 / len(w) or w[2] < .5 / len(w) for w in odd]) > .9  # not the even weights of a plain mean


def test_toxicity_on_held_out_documents(spark):
    bad = ["grawlix", "snarfle", "blort", "zounds"]
    df, labels = labelled(spark, lambda rng, t: f"{t} {' '.join(rng.sample(bad, rng.choice([1, 2, 4])))}. {text(rng, 5)}", n=1200)
    odd = spark.createDataFrame([(d, t, "x", 3, 1.5) for d, t in ODD], df.schema)
    toxic = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, label int")
    rows = toxicity.severity(df.unionByName(odd), toxic).collect()
    want, texts = dict(labels), {r.doc_id: r.text for r in df.collect()}
    assert len(rows) == len(want) + len(ODD)
    held = [r for r in rows if r.held_out and r.doc_id in want]
    assert np.mean([r.toxic == bool(want[r.doc_id]) for r in held]) > .97
    assert not any(r.toxic for r in rows if r.doc_id not in want)
    grade = {k: np.mean([r.expected_severity for r in held if sum(b in texts[r.doc_id] for b in bad) == k]) for k in (0, 1, 2, 4)}
    assert grade[0] < grade[1] < grade[2] < grade[4] <= 3
    assert all(0 <= r.score <= 1 and 0 <= r.severity <= 3 for r in rows)


def test_toxicity_with_given_grades_and_without_any(spark):
    df = spark.createDataFrame([(i, "fine words " + "bad" * (i % 3 > 0) + " worse" * (i % 3 > 1)) for i in range(600)], "doc_id long, text string")
    grades = df.selectExpr("doc_id", "cast(doc_id % 3 as int) as label")
    rows = toxicity.severity(df, grades, levels=3).collect()
    assert all(r.severity == r.doc_id % 3 for r in rows)
    assert max(r.expected_severity for r in toxicity.severity(df, grades.limit(0)).collect()) < .01
    assert toxicity.severity(df.limit(0), grades).collect() == []


def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    m = {"w": rng.normal(size=1 << toxicity.BITS) * .5, "t": np.array([.3, -.2, .1])}
    places, n, grade = np.array([1, 2, 3, 2, 5, 9]), np.array([2, 3, 1, 0]), np.array([0, 2, 3, 1])

    def loss(m):
        edge = np.hstack([np.ones((4, 1)), toxicity.above(m, places, n), np.zeros((4, 1))])
        return -np.mean(np.log(edge[np.arange(4), grade] - edge[np.arange(4), grade + 1]))

    g = toxicity.gradient(m, places, n, grade)
    for k, i in (("w", 2), ("w", 9), ("w", 1), ("t", 0), ("t", 1), ("t", 2)):
        up, down = ({a: b.copy() for a, b in m.items()} for _ in range(2))
        up[k][i] += 1e-6
        down[k][i] -= 1e-6
        assert g[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-6, rel=1e-4)
    assert (np.diff(toxicity.thresholds(m)) > 0).all()


def test_one_very_long_text_does_not_empty_the_quality_fit(spark):
    good, bad = "a calm and plain line of prose here ", "#$% 77 !!|| 12 ** &&& 9 #!# "
    rows = [(i, (good if i % 2 else bad) * (3 if i else 60000)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, label int")
    out = quality.quality_scores(docs, labels, max_docs=80, max_passages=160).collect()
    assert sum((r.score > 0.5) == bool(r.doc_id % 2) for r in out) >= 76
    assert quality.keep_good(docs.withColumn("__score", F.lit(1)), labels, max_docs=80, max_passages=160).columns == ["doc_id", "text", "__score"]
