import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gemstats.llm import mixing


def water(sizes, weights=(1, 2, 3), times=3):
    """Targets by sharing again and again, exactly."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(times * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        goal = {s: Fraction(times * sizes[s]) if s in capped else Fraction(rest * w[s], free) for s in order}
        over = {s for s in order if s not in capped and goal[s] > times * sizes[s]}
        if not over:
            return goal
        capped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 1, None: 5}, {"x": 0, "y": 7}, {"é": 3, "z": 900, "Z": 20, "": 4, "zz": 1},
    {"only": 5}, {f"s{i}": (i * 37) % 101 for i in range(20)}])
def test_targets_match_exact_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys()
    for s in got:
        assert math.isclose(got[s], float(want[s]), rel_tol=1e-12, abs_tol=1e-9)


def docs(spark, n=3000):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), None if i % 11 == 0 else f"s{min(i % 9, 3)}", "t", 1) for i in range(n)]
    rows += [(None, None, "s1", "t", 1), (1, "again and again", "s2", "t", 2), (1, "again and again", "s2", "t", 2), (5, "", "", "t", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string, taken int")


def test_mix_meets_targets_and_reruns_agree(spark):
    df = docs(spark)
    first = mixing.mix(df, bins=16)
    rows = first.collect()
    assert len(rows) == df.count()
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    by = first.join(df.select("source", F.xxhash64("doc_id", "source", "text").alias("mark")).distinct(), "mark") \
        .groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.sum("size").alias("size"), F.max("source_size").alias("ss")).collect()
    for r in by:
        assert r["size"] == r.ss
        assert abs(r.taken - r.target) <= 12
    key = lambda r: (str(r.mark), r.taken)
    assert sorted(mixing.mix(df.repartition(5), bins=900).collect(), key=key) == sorted(rows, key=key)


def test_weights_favour_better_documents(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "if(id % 2 = 0, 'good words here', 'bad bad words') as text", "concat('s', id % 3) as source")
    good = F.when(F.col("text").startswith("good"), 1.0).otherwise(0.1)
    taken = {r.good: r.t for r in mixing.mix(df, quality=good, weights=(1, 1, 2)).join(df, "doc_id")
             .filter("source != 's2'").groupBy(F.col("text").startswith("good").alias("good")).agg(F.sum("taken").alias("t")).collect()}
    assert taken[True] > 1.3 * taken[False]


def test_empty_table_and_main_path_without_python(spark):
    df = docs(spark).limit(0)
    assert mixing.mix(df).collect() == []
    plan = mixing.mix(docs(spark, 50))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
