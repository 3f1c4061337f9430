import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gemstats.llm import attention, lm_score


def corpus(n=260):
    rng = random.Random(5)
    parts = ["ba", "do", "ki", "lu", "me", "ra", "su", "ti"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 2, 3, 4])))
    say = lambda: " ".join(rng.choice(["the", "Of", "AND", word(), word(), word() + ",", "été"]) for _ in range(rng.choice([0, 1, 9, 60])))
    rows = [(i, say()) for i in range(n)]
    return rows + [(None, "null id the"), (700, None), (701, " \t\x0b"), (702, "x" * 3000), (703, "the " * 4000), (704, "a b    c"), (5, rows[5][1])]


def brute(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    c = Counter(w for (d, _), ws in zip(rows, tokens, strict=True) if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted([(d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in ws), 6))
                   for (d, _), ws in zip(rows, tokens, strict=True)], key=str)


@pytest.mark.parametrize("head", [100_000, 7])
def test_counts_and_base_match_brute_force(spark, head):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, word string, score double")
    got = lm_score.lm_scores(df, head_words=head, rounds=2).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_where_a_word_meets_its_count_changes_nothing(spark):
    df = spark.createDataFrame(corpus(60), "doc_id long, text string")
    scores = [sorted((str(r.doc_id), round(r.score, 3)) for r in lm_score.lm_scores(df, head_words=h, rounds=1).collect()) for h in (100_000, 3)]
    assert scores[0] == scores[1]


def test_empty_and_unlearned_tables(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    got = lm_score.lm_scores(df).collect()
    assert got and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)
    assert lm_score.lm_scores(df.limit(0)).collect() == []


def test_windows_score_each_token_once_with_context():
    n = np.array([1, 24, 25, 49, 3, 200])
    ids = np.arange(n.sum()) % 250
    x, y, real = lm_score.windows(ids, n, 256)
    assert (y[real > 0] == ids).all()
    begin = np.cumsum(n) - n
    own = np.concatenate([np.arange(k) for k in n])
    doc = np.repeat(np.arange(len(n)), n)
    rows, cols = np.nonzero(real)
    for token, (r, c) in enumerate(zip(rows, cols, strict=True)):
        seen = x[r, :lm_score.OVERLAP + c + 1]
        context = min(own[token], lm_score.OVERLAP + 1 + c)
        first = begin[doc[token]] + own[token] - context
        assert (seen[len(seen) - context:] == ids[first:first + context]).all()
        assert (seen[:len(seen) - context] == 256).all()
        assert context >= min(own[token], lm_score.OVERLAP)


def model():
    rng = np.random.default_rng(0)
    m = attention.start(9, np.ones(8) / 8, 6, 4)
    return {k: (v + rng.normal(size=v.shape) * .4).astype(np.float32) for k, v in m.items()}, rng


def test_scores_equal_a_plain_masked_attention():
    m, rng = model()
    ids, nexts = rng.integers(0, 9, (5, 6)), rng.integers(0, 8, (5, 4))
    marked = np.array([1, 0, 0, 1, 1, 0, 0, 0], np.float32)
    lp, ls = attention.log_probs(m, ids, nexts, 2, marked, at_once=2)
    for i in range(5):
        x = m["E"][ids[i]] + m["P"]
        for c in range(4):
            at = c + 2
            w = np.array([x[at] @ m["Q"] @ (x[j] @ m["K"]) / 2 for j in range(at + 1)])
            w = np.exp(w) / np.exp(w).sum()
            y = x[at] + sum(w[j] * (x[j] @ m["V"]) for j in range(at + 1))
            z = (y + np.maximum(y @ m["A"] + m["a"], 0) @ m["B"]) @ m["O"] + m["o"]
            p = np.exp(z) / np.exp(z).sum()
            assert lp[i, c] == pytest.approx(np.log(p[nexts[i, c]]), abs=1e-4)
            assert ls[i, c] == pytest.approx(np.log(p @ marked), abs=1e-4)
    huge = m | {"Q": m["Q"] * 300, "O": m["O"] * 300}  # exponents that float32 can't hold
    fast, slow = attention.log_probs(huge, ids, nexts, 2, marked), attention._careful(huge, ids, nexts, 2, marked)
    assert np.isfinite(fast).all() and np.allclose(fast, slow, atol=1e-3)
    later = ids.copy()
    later[:, -1] = (later[:, -1] + 1) % 9  # what comes later is not seen
    assert np.allclose(attention.log_probs(m, later, nexts, 2, marked)[0][:, :-1], lp[:, :-1])


def test_gradient():
    m, rng = model()
    m = {k: v.astype(np.float64) for k, v in m.items()}
    ids, nexts, w = rng.integers(0, 9, (3, 6)), rng.integers(0, 8, (3, 4)), rng.integers(0, 2, (3, 4)).astype(float)
    w[0] = 1

    def loss(m):
        z, _ = attention._attend(m, ids, 2)
        z = z @ m["O"] + m["o"]
        lp = np.take_along_axis(z - np.log(np.exp(z).sum(2, keepdims=True)), nexts[:, :, None], 2)[:, :, 0]
        return -(lp * w).sum() / w.sum()

    g = attention.gradient(m, ids, nexts, w, 2)
    for k in m:
        i = tuple(rng.integers(0, s) for s in m[k].shape)
        up, down = ({a: b.copy() for a, b in m.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert g[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-7)


def test_word_probabilities_of_the_mixture_sum_to_at_most_one():
    """Over all words of two places, spelled by a tiny vocabulary of start and inner classes."""
    m, rng = model()
    starts = np.array([1, 1, 1, 0, 0, 0, 0, 1], np.float32)  # 7 is the end
    total = 0.0
    blank = 8
    for a in range(3):
        for b in [None, 3, 4, 5, 6]:
            for c in ([None, 3, 4, 5, 6] if b is not None else [None]):
                own = [x for x in (a, b, c) if x is not None]
                ids = np.full((1, 6), blank)
                ids[0, 3:3 + len(own)] = own
                lp, ls = attention.log_probs(m, ids, np.array([[*own, 7, 7, 7][:4]]), 2, starts)
                total += math.exp(lp[0, :len(own)].sum() - ls[0, 0] + ls[0, len(own)])
    lp, ls = attention.log_probs(m, np.full((1, 6), blank), np.array([[7, 0, 0, 0]]), 2, starts)
    total += math.exp(lp[0, 0] - ls[0, 0])  # the end itself
    assert 0.3 < total <= 1 + 1e-5


def test_weights_are_fitted_on_every_training_window(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([0, 5, 30, 90])))) for i in range(900)]
    kept = {}
    plain = lm_score.written
    monkeypatch.setattr(lm_score, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    monkeypatch.setattr(lm_score, "remove", lambda df: None)
    lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), rounds=2)
    learned = [t for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    n = [len(lm_score.subwords(t.encode().split(), lm_score.TOKENIZER)[0]) + 1 for t in learned]
    windows = kept["windows"].selectExpr("w", "copies" if "copies" in kept["windows"].columns else "1 as copies").collect()
    assert sum(r.copies for r in windows) == sum(-(-k // lm_score.STEP) for k in n)
    seen = [(np.frombuffer(r.w, np.uint8)[lm_score.OVERLAP + 1:] != lm_score.CLASSES).sum() * r.copies for r in windows]
    assert sum(seen) == sum(n)


def test_gradient_with_exponents_that_float32_cannot_hold():
    m, rng = model()
    ids, nexts, w = rng.integers(0, 9, (3, 6)), rng.integers(0, 8, (3, 4)), np.ones((3, 4), np.float32)
    for up in (100, -100):  # a constant on all logits changes nothing
        g, h = attention.gradient(m, ids, nexts, w, 2), attention.gradient(m | {"o": m["o"] + np.float32(up)}, ids, nexts, w, 2)
        assert all(np.allclose(g[k], h[k], atol=1e-4) for k in g)


def test_a_training_run_uses_each_of_its_windows_once(spark, monkeypatch):
    monkeypatch.setattr(attention, "LEAST_STEPS", 4, raising=False)  # 256 windows make a run
    made = []
    df = spark.createDataFrame([(i, f"w{i % 7} the of " * 400) for i in range(40)], "doc_id long, text string")
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **k: made.append(f) or plain(self, f, *a, **k))
    lm_score.lm_scores(df, rounds=1, per_task=256)
    trained = next(f for f in made if f.__name__ == "trained")
    sizes = []
    gradient = attention.gradient
    monkeypatch.setattr(attention, "gradient", lambda m, ids, *a: sizes.append(len(ids)) or gradient(m, ids, *a))
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, lm_score.CLASSES, lm_score.CONTEXT + 1).astype(np.uint8).tobytes() for _ in range(300)]
    out = list(trained(iter([pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["w"])])))
    assert out[0].column(0).to_pylist() == [300]
    assert sum(sizes) == 300


def test_gradient_with_attention_exponents_that_float32_cannot_hold():
    m, rng = model()
    ids, nexts, w = rng.integers(0, 9, (3, 6)), rng.integers(0, 8, (3, 4)), np.ones((3, 4), np.float32)
    huge = m | {"Q": m["Q"] * 100}
    g, h = (attention.gradient({k: v.astype(t) for k, v in huge.items()}, ids, nexts, w, 2) for t in (np.float32, np.float64))
    assert all(np.isfinite(g[k]).all() and np.allclose(g[k], h[k], atol=1e-2 * abs(h[k]).max()) for k in g)


def test_one_block_of_logits_is_held_at_a_time():
    rng = np.random.default_rng(0)
    m = attention.start(lm_score.CLASSES + 1, np.ones(lm_score.CLASSES) / lm_score.CLASSES, 32, 16)
    ids, nexts = rng.integers(0, lm_score.CLASSES, (32, 32)), rng.integers(0, lm_score.CLASSES, (32, 24))  # two blocks
    z, out = attention._attend(m, ids, 8)[1][0], np.vstack([m["O"], m["o"]])
    block = attention.ROWS * lm_score.CLASSES * 4
    tracemalloc.start()
    attention._output_gradient(z, out, nexts.reshape(-1), np.ones(32 * 24, np.float32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * block
