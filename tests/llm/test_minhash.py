"""MinHash components against all pairs of full shingle sets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from gemstats.llm import minhash
from gemstats.llm.common import written
from gemstats.llm.minhash import minhash_groups, signatures

SCHEMA = "doc_id long, text string"


def sets_of(rows):
    out = []
    for _, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append(frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def by_hand(rows):
    sets, index, up = sets_of(rows), defaultdict(list), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, own in enumerate(sets):
        for j, both in Counter(j for g in own for j in index[g]).items():
            if 100 * both >= 85 * (len(own) + len(sets[j]) - both):
                up[top(i)] = top(j)
        for g in own:
            index[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i)), d == least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def groups(df):
    return sorted((tuple(r) for r in minhash_groups(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def edited(rnd, words, n):
    words = list(words)
    for i in rnd.sample(range(len(words)), n):
        words[i] = f"edit{rnd.random()}"
    return " ".join(words)


def test_copies_chains_and_edge_texts(spark):
    rnd = random.Random(1)
    word = [f"w{i}" for i in range(500)]
    rows, at = [], 0
    for _ in range(12):  # originals with copies that differ by none to six words
        base = rnd.choices(word, k=rnd.choice([6, 40, 200, 400]))
        for n in range(7):
            rows.append((at := at + 1, edited(rnd, base, min(n, len(base)))))
    for text in (None, "", " \t\n", "one", "ONE", "one two three", "One  two\nthree", "a b c d e", "a b c d e f"):
        rows += [(at := at + 1, text), (at := at + 1, text)]
    rows += [rows[3], rows[3], (None, rows[0][1]), (None, "only null here at all times"), (-2**63, rows[8][1])]
    assert groups(spark.createDataFrame(rows, SCHEMA).repartition(3)) == by_hand(rows)


def test_many_edited_copies_of_one_text_that_link_only_through_it(spark):
    rnd = random.Random(2)
    base = [f"t{i}" for i in range(160)]
    rows = [(1000, " ".join(base))] + [(i, edited(rnd, base, 2)) for i in range(300)]
    want = by_hand(rows)
    assert len({r[2] for r in want}) == 1
    assert groups(spark.createDataFrame(rows, SCHEMA)) == want


def test_texts_that_share_a_passage_are_left_alone_and_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rnd = random.Random(4)
    shared = [f"s{i}" for i in range(100)]
    rows = [(i, " ".join(shared + [f"own{i}x{k}" for k in range(rnd.choice([12, 20, 30]))])) for i in range(60)]
    rows += [(100 + i, " ".join(shared[:90] + [f"own{i}x{k}" for k in range(8)])) for i in range(30)]
    assert groups(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_empty_table_and_extra_columns(spark):
    assert groups(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, "the same words here again"), (2, "The same words  here again")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", row long, n long, signature string")
    assert groups(df) == by_hand(rows)


def test_signature_distance_follows_similarity():
    rnd = np.random.default_rng(5)
    for alike in (0.5, 0.85, 0.95):
        apart = []
        for _ in range(200):
            n = 400
            both = round(2 * n * alike / (1 + alike))
            pool = rnd.integers(0, 2**63, 2 * n - both, np.uint64)
            x, y = signatures(np.concatenate([pool[:n], pool[-n:]]), np.array([n, n]))
            apart.append(int((x != y).sum()))
        assert abs(np.mean(apart) / minhash.SYMBOLS - (1 - alike) * 255 / 256) < 0.02


def test_all_pairs_under_the_signature_distance_meet(spark):
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 256, minhash.WIDTH, np.uint8)
    rows = [(0, bytes(base))]
    for i in range(1, 200):
        other = base.copy()
        at = rnd.choice(minhash.SYMBOLS, 19, replace=False)
        other[at] += rnd.integers(1, 255, 19, np.uint8)
        rows.append((i, bytes(other)))
    keys = minhash.keys(spark.createDataFrame(rows, "node long, signature binary"))
    own = keys.filter("node = 0").select("key")
    assert keys.join(own, "key", "left_semi").select("node").distinct().count() == 200


def test_odd_sketches_never_exceed_the_difference_and_keep_all_links():
    rnd = np.random.default_rng(8)
    for n, both in ((50, 47), (300, 276), (300, 240), (5000, 4600), (20000, 10000)):
        pool = np.unique(rnd.integers(0, 2**63, 2 * n, np.uint64))[:2 * n - both]
        rnd.shuffle(pool)
        every, size = np.concatenate([pool[:n], pool[n - both:]]), np.array([n, len(pool) - n + both])
        x, y = np.concatenate([signatures(every, size), minhash.odd_sketches(every, size)], axis=1)
        apart = int(np.bitwise_count(x[minhash.SYMBOLS:] ^ y[minhash.SYMBOLS:]).sum())
        assert apart <= 2 * (n - both)
        linked = 100 * both >= 85 * (2 * n - both)
        if linked:
            assert minhash.likely(x[None], y, size[:1], size[1:], 85).all()
        elif n <= 300:
            assert not minhash.likely(x[None], y, size[:1], size[1:], 85).any()


def test_only_texts_of_pairs_are_moved(spark):
    say = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    texts = written(spark.createDataFrame([(i, bytes(say(i % 90), "ascii")) for i in range(100)], "node long, text binary"), "texts")
    pairs = written(spark.createDataFrame([(3, 93), (4, 5)], "a long, b long"), "pairs")
    found = minhash.confirmed(pairs, texts)
    assert [tuple(r) for r in found.collect()] == [(3, 93)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    none = written(pairs.limit(0), "pairs")
    assert minhash.confirmed(none, texts).collect() == []
