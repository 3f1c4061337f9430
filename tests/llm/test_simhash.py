import random

import numpy as np
import xxhash

from gemstats.llm import graph
from gemstats.llm import simhash as sh


def fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fps, distance=4):
    """Root (smallest index) of each fingerprint by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    root, least = roots(fps), {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root, strict=True)), key=str)


def kept_ids(rows):
    """The smallest id of each component; an id can stand for two of them."""
    least = {}
    for (d, _), r in zip(rows, roots([fingerprint(t) for _, t in rows]), strict=True):
        least.setdefault(r, []).extend([] if d is None else [d])
    return sorted((min(ids, default=None) for ids in least.values()), key=str)


def texts(rng):
    base = [" ".join(rng.choice("Aa be Ça da e fo gu".split()) + str(rng.randrange(40)) for _ in range(rng.choice([1, 3, 4, 5, 30, 300])))
            for _ in range(12)]
    out = [None, "", "\t ", "one", "ONE", "one two", "a\x0bb"]
    for t in base:
        out.append(t)
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            out.append(" ".join(w))
    return out


def test_groups_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i * 3 % 101 + 1, t) for i, t in enumerate(texts(rng))] + [(None, "lonely text"), (5, "one"), (5, "one")]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sh.simhash_groups(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    kept = sh.simhash_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == kept_ids(rows)


def test_dedup_of_ids_that_repeat_keeps_a_row_of_each_component(spark):
    rows = [(5, "one two three four five"), (5, "quite another text than that one"), (5, "one two three four five"), (6, "one two three four five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in sh.simhash_dedup(df).collect()) == sorted(rows[:2])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sh.simhash_groups(df).collect() == []


def near_words(rng, n):
    """Fingerprints in chains and clusters, some exactly 4 or 5 bits apart."""
    out = set()
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 6, 30])):
            out.add(f)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5, 6])):
                f ^= 1 << b
    return sorted(out)


def linked(spark, fps, **params):
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node: r.root for r in graph.components(sh.fingerprint_links(df, **params)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    groups = {}
    for i, f in enumerate(signed):
        groups.setdefault(found.get(f, f), set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_links_match_all_pairs_for_any_block_choice_and_for_hot_keys(spark):
    fps = near_words(random.Random(2), 300)
    root = roots(fps)
    want = sorted(sorted(i for i in range(len(fps)) if root[i] == r) for r in set(root))
    for params in ({}, {"extra": 1}, {"extra": 1, "hot": 3}):
        assert linked(spark, fps, **params) == want


def test_walk_spans_a_dense_cluster_with_a_tree():
    rng = np.random.default_rng(0)
    fps = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 10, (500, 3)).astype(np.uint64), axis=1))
    assert len(sh._walk(fps, 4)) == len(fps) - 1


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (300, 200)]
    rng = random.Random(4)
    rng.shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {x: 100 for x in range(101, 140)} | {300: 200}
