import random

import numpy as np
import pytest

from gemstats.llm import line_dedup as ld


def brute(rows, min_chars):
    """Deletes every line that lies in a run of enough characters that occurs
    earlier, by comparing all pairs of places."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    docs = [(rows[i][1] or "").split("\n") for i in order]
    places = [(d, i) for d, own in enumerate(docs) for i in range(len(own))]
    gone = [set() for _ in docs]
    for k, (d, i) in enumerate(places):
        for e, j in places[:k]:
            n = 0
            while i + n < len(docs[d]) and j + n < len(docs[e]) and docs[d][i + n] == docs[e][j + n]:
                n += 1
            if n and sum(map(len, docs[d][i:i + n])) >= min_chars:
                gone[d].update(range(i, i + n))
    out = []
    for i, own, g in zip(order, docs, gone, strict=True):
        text = rows[i][1] if not g else "\n".join(x for k, x in enumerate(own) if k not in g)
        out.append((rows[i][0], len(own), len(g), text))
    return sorted(out, key=str)


def result(spark, rows, min_chars):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, line string, row int")
    return sorted((tuple(r[c] for c in ("doc_id", "n_lines", "n_deleted", "text")) for r in ld.line_dedup(df, min_chars).collect()), key=str)


@pytest.mark.parametrize("min_chars", [1, 7, 20])
def test_matches_comparing_all_places(spark, min_chars):
    rng = random.Random(min_chars)
    pool = ["", "a", "bb", "ccc", "a longer line here", "another é line, longer still", "x"]
    rows = [(i, "\n".join(rng.choice(pool) + ("" if rng.random() < .5 else str(rng.randrange(4))) for _ in range(rng.choice([1, 2, 4, 12]))))
            for i in range(40)]
    shared = "one line\nand two\nand three, long enough"
    rows += [(50 + i, f"own {i}\n{shared}\nend {i}") for i in range(4)] + [(60, "\n" * 30), (61, "\n" * 30 + "z" * 9)]
    rows += [(None, shared), (70, None), (71, ""), (72, "same row of the table"), (72, "same row of the table"), (73, "r" * 30 + "\r\n" + "r" * 30)]
    assert result(spark, rows, min_chars) == brute(rows, min_chars)


def test_empty_table(spark):
    assert result(spark, [], 20) == []


def test_ranks_are_places_in_sorted_order(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(-5, 5), rng.randrange(3)) for _ in range(300)]
    got = {(r.a, r.b): (r["rank"], r.n) for r in ld.ranks(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {p: (sum(q < p for q in pairs), pairs.count(p)) for p in set(pairs)}


def test_shortest_runs():
    chars = np.array([5, 15, 30, 0, 4])
    assert ld.shortest_runs(chars, 20) == [[2], [2], [1, 2, 3], [], []]
    assert ld.shortest_runs(np.array([3]), 20) == [[]]
