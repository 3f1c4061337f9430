"""Spelling forms against a comparison through deleted letters."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gemstats.llm import spelling
from gemstats.llm.spelling import neighbours, roots, spelling_forms

SCHEMA = "doc_id long, text string"


def counts_by_hand(rows):
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += len(w) >= 7
    return {w: n for w, n in out.items() if n >= 2}


def near_by_hand(words):
    masks, near = defaultdict(set), {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            masks[w[:i] + "?" + w[i + 1:]].add(w)
            short = w[:i] + w[i + 1:]
            if short in near:
                near[w].add(short)
                near[short].add(w)
    for alike in masks.values():
        for w in alike:
            near[w] |= alike - {w}
    return near


def by_hand(rows):
    n = counts_by_hand(rows)
    near, form = near_by_hand(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def forms(df):
    return sorted(tuple(r) for r in spelling_forms(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_random_words_with_edits(spark):
    rnd = random.Random(7)
    letters = "abcdéÿZ"
    stems = ["".join(rnd.choices(letters, k=rnd.choice([7, 8, 9, 12, 20]))) for _ in range(12)]
    rows = [(None, "Examples examples"), (3, None), (4, ""), (5, "1234 -- Āā"), (6, "x" * 100000 + " " + "x" * 99999), (6, "x" * 100000 + " " + "x" * 99999)]
    for d in range(60):
        words = []
        for _ in range(60):
            w = rnd.choice(stems)
            for _ in range(rnd.choice([0] * 12 + [1, 2])):
                i = rnd.randrange(len(w))
                w = w[:i] + rnd.choice([rnd.choice(letters), "", w[i] + rnd.choice(letters)]) + w[i + 1:]
            words.append(w)
        rows.append((d % 50 or None, rnd.choice([" ", "-", "\n"]).join(words)))
    got = forms(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == by_hand(rows)
    assert sum(r[1] is not None for r in got) > 20


@pytest.mark.parametrize("length", [1, 2, 7, 8, 63, 64, 65, 130])
def test_every_kind_of_edit_meets_once(spark, length):
    rnd = random.Random(length)
    base = "".join(rnd.choices("ab", k=length))
    words = {base} | {base[:i] + c + base[i + k:] for i in range(length) for k in (0, 1) for c in ("a", "b", "ÿ", "")}
    words = {w: rnd.randint(1, 5) for w in words if w}
    got = {r.word: (r.n_near, r.best, r.best_n) for r in neighbours(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    near = near_by_hand(words)
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    assert got == {w: (len(near[w]), b, words[b]) for w, b in best.items()}


def test_large_tiles_are_compared_by_blocks():
    words = sorted({f"{chr(a)}{chr(b)}stem" for a in range(97, 123) for b in range(97, 123)})
    n = len(words)
    one = np.zeros(n, np.int64)
    at, count, best = spelling._tile(one, one + 6, one, one + 2, pa.array([w.encode() for w in words]), np.ones(n, np.int64), room=1 << 10)
    near = near_by_hand(words)
    assert [words[i] for i in at] == words
    assert count.tolist() == [len(near[w]) for w in words]
    assert [words[i] for i in best] == [min(near[w]) for w in words]


def test_long_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("other", "w5")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w13" for w, _ in chain}


def test_empty_table_and_extra_columns(spark):
    assert forms(spark.createDataFrame([], SCHEMA)) == []
    rows = [(i, "Wonderful wonderfull wonderful") for i in range(8)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", word string, n long, key long")
    assert forms(df) == by_hand(rows)
