import numpy as np

from gemstats.operators import sketches as skt


def test_quantiles_of_parts_that_arrive_one_by_one(spark, scratch):
    rnd = np.random.default_rng(5)
    rows = [("ab"[i % 2], None if i % 50 == 0 else float(v)) for i, v in enumerate(np.round(rnd.lognormal(3, 1, 30000), 2))]
    df = spark.createDataFrame(rows, "k string, v double")
    for lo in range(0, 30000, 7000):
        skt.add_part(spark.createDataFrame(rows[lo:lo + 7000], "k string, v double"), "v", ["k"], f"{scratch}/s", k=800)
    found = skt.merged_quantiles(spark.read.parquet(f"{scratch}/s"), [0.0, 0.01, 0.5, 0.99, 1.0], ["k"], k=800)
    off = skt.rank_check(df, "v", found, ["k"]).collect()
    assert len(off) == 10 and all(r.off <= skt.rank_error(800) for r in off)
    for k in "ab":
        assert {r.n for r in off if r.k == k} == {sum(1 for g, v in rows if g == k and v is not None)}


def test_no_values_no_sketch(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert skt.merged_quantiles(skt.sketch_parts(df, "v", ["k"]), [0.5], ["k"]).count() == 0
