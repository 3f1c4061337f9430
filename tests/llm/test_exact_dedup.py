import hashlib
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gemstats.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, kept string, n_bytes string, mark string"


def brute(rows):
    """doc_id, text -> sorted result rows."""
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, i, d))
    out = []
    for norm, own in groups.items():
        own.sort()
        for k, (*_, d) in enumerate(own):
            out.append((d, own[0][-1], len(own), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **params):
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)
    got = ed.exact_groups(df, **params).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted((tuple(r) for r in got.collect()), key=str)


def cases(seed=3):
    rng = random.Random(seed)
    texts = [None, "", " \n", "a b", "ab", "a\tb ", "é x", "éx", "long " * 500, "long" * 500, " ", "a\x00b"]
    rows = [(i, rng.choice(texts)) for i in range(60)]
    return rows + [(None, "a b"), (None, "solo"), (7, "rep"), (7, "rep"), (8, "rep"), (-3, "éx")]


def test_groups_match_brute_force(spark):
    rows = cases()
    assert result(spark, rows) == brute(rows)


def test_huge_documents_are_hashed_in_pieces(spark):
    rows = cases(5) + [(100, "w " * 3000), (101, "w" * 3000), (102, "w " * 2999 + "v")]
    assert result(spark, rows, huge_bytes=50, piece_bytes=37) == brute(rows)


@pytest.mark.parametrize("primes", [(2, 3), (1, 1)])
def test_equal_fingerprints_of_different_texts_come_apart(spark, primes):
    rows = [(i, w) for i, w in enumerate(["ab", "ba", "cd", "ab", "dc", "xyz", "zyx", "ba", "", None, "b a"])]
    assert result(spark, rows, primes=primes, per_task=2, chunk=1) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_dedup_keeps_one_of_each_with_all_columns(spark):
    rows = cases()
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)
    kept = ed.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in brute(rows) if r[3]), key=str)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 400), st.integers(1, 50))
def test_fingerprints_compose(data, cut, chunk):
    a, b = data[:cut], data[cut:]
    for base, prime in zip(ed.BASES, ed.PRIMES, strict=True):
        whole = sum(x * pow(base, i, prime) for i, x in enumerate(data)) % prime
        assert ed.fingerprint(data, base, prime, chunk) == whole
        parts = (ed.fingerprint(x, base, prime, chunk) for x in (a, b))
        assert ed.combine(next(parts), len(a), next(parts), base, prime) == whole


def test_smallest_possible_id(spark):
    rows = [(-2**63, "a b"), (2**63 - 1, "ab "), (None, "a b"), (-1, "ab")]
    got = ed.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.keep_id for r in got} == {-2**63} and sum(r.kept for r in got) == 1
