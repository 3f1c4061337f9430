import random

import numpy as np

from gemstats.llm import decontaminate as dc


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, max(new)), new
    return best


def test_alignment_matches_the_cell_by_cell_matrix():
    rng = random.Random(0)
    pairs = [([rng.randrange(1, 6) for _ in range(rng.randrange(1, 14))], [rng.randrange(1, 8) for _ in range(rng.randrange(1, 25))])
             for _ in range(200)]
    score, _ = dc.align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert score.tolist() == [smith_waterman(a, b) for a, b in pairs]


def corpus():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(5000)] + ["the", "of", "é"] * 200
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, say(rng.choice([8, 20, 45]))) for i in range(30)] + [(90, ["one", "two"]), (91, []), (None, say(20))]
    docs, want = [], {}
    for d in range(120):
        body = say(rng.choice([0, 5, 60, 400]))
        if d % 2:
            k = rng.randrange(len(items) - 3)
            copy = list(items[k][1])
            kind = d % 3
            if kind == 1:  # every seventh word replaced
                copy = [w if j % 7 else "changed" for j, w in enumerate(copy)]
            elif kind == 2 and len(copy) > 8:  # words added and left out
                copy = copy[:5] + ["and", "so"] + copy[6:]
            at = rng.randrange(len(body) + 1)
            body = body[:at] + copy + body[at:]
            want[d] = items[k][0]
        docs.append((d, " ".join(body).upper() if d % 5 == 0 else ", ".join(body)))
    return docs, [(i, " ".join(t) + ".") for i, t in items], want


def brute(docs, items, threshold=0.4):
    out = {}
    for d, t in docs:
        b = dc.words((t or "").encode())
        for i, x in items:
            a = dc.words((x or "").encode())
            if len(a) >= 3 and smith_waterman(a, b) >= threshold * 2 * len(a):
                out[d, i] = smith_waterman(a, b) / (2 * len(a))
    return out


def test_leaks_match_aligning_everything(spark):
    docs, items, want = corpus()
    docs = docs + [(None, items[3][1]), (500, None), (501, ""), (502, items[-1][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, score int")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items] + [(92, None, "y")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in dc.find_leaks(df, bench).collect()}
    whole = brute(docs, items)
    assert got.keys() == whole.keys()
    assert {(d, i) for d, i in want.items()} <= got.keys()
    for key, r in got.items():
        assert abs(r.score - whole[key]) < 1e-9
    text = dict(docs)
    r = got[502, None]
    assert (r.begin_word, r.end_word) == (0, len(dc.words(text[502].encode())))
    # blocks of the benchmark change nothing
    again = {(r.doc_id, r.item_id, r.score) for r in dc.find_leaks(df, bench, block_bytes=900).collect()}
    assert again == {(d, i, r.score) for (d, i), r in got.items()}
    kept = dc.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {k[0] for k in whole})


def test_passage_that_a_third_of_all_documents_share_is_found(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    df = spark.createDataFrame([(i, f"a{i} b{i} " + (passage if i % 3 == 0 else "c d")) for i in range(90)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r.doc_id for r in dc.find_leaks(df, bench).collect()) == list(range(0, 90, 3))


def test_edited_copy_that_a_third_of_all_documents_share_is_found(spark):
    item = [f"p{i}" for i in range(25)]
    copy = " ".join(w if k % 5 != 2 else f"changed{k}" for k, w in enumerate(item))
    docs = [(i, f"a{i} b{i} " + (copy if i % 3 == 0 else " ".join(item) if i == 1 else "c d")) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in dc.find_leaks(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {d: v for (d, _), v in brute(docs, [(1, " ".join(item))]).items()} and sorted(got) == sorted([1, *range(0, 300, 3)])


def test_seeds_of_whole_documents_go_together():
    items = dc.block([(0, b"a b c d"), (1, b"b c d e"), (2, b"x b c d")], 3)
    tokens, ends = dc._numbered([b"a b c d e", b"", b"x b c d b c d", b"q", b"b c d"], items)
    at, gram = dc._found(tokens, items)
    for most in (1, 2, 5, 100):
        parts = list(dc._parts(at, gram, ends, items, most))
        assert np.concatenate([p for p, _ in parts]).tolist() == at.tolist() and np.concatenate([g for _, g in parts]).tolist() == gram.tolist()
        docs = [set((np.searchsorted(ends, p, "right") - 1).tolist()) for p, _ in parts]
        assert all(docs) and sum(map(len, docs)) == len(set.union(*docs)) == 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert dc.find_leaks(docs, bench.limit(0)).collect() == []
    assert dc.find_leaks(docs.limit(0), bench).collect() == []
    assert dc.decontaminate(docs, bench.limit(0)).count() == 1
