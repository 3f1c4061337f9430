import json

import numpy as np

from gemstats.operators import correlation, insight, profile
from gemstats.operators.moments import corr_sql, merged, moments, rolled_up, std_sql

COLUMNS, PAIRS = ["v", "p"], {"r": ("p", "v")}


def _figures(df):
    return df.selectExpr("*", f"{std_sql('v')} AS std", f"{corr_sql('r')} AS corr")


def _rows(offset=0.0, n=400):
    rnd = np.random.default_rng(3)
    v = offset + rnd.integers(0, 64, n) / 1024
    p = 10 * offset + np.round(3 * (v - offset) + rnd.random(n) / 8, 6)
    return [("ab"[i % 2], "xyz"[i % 3], None if i % 17 == 0 else float(v[i]), None if i % 19 == 0 else float(p[i])) for i in range(n)]


def _want(rows):
    v = np.array([r[2] for r in rows if r[2] is not None])
    both = np.array([(r[2], r[3]) for r in rows if r[2] is not None and r[3] is not None])
    both = both - both[0]
    return len(rows), np.std(v - v[0], ddof=1), np.corrcoef(both.T)[0, 1]


def test_rolled_up_moments_of_values_far_from_zero(spark):
    for offset in (0.0, 1e8, -1e12 / 1024):
        rows = _rows(offset)
        df = spark.createDataFrame(rows, "k string, g string, v double, p double")
        up = {(r._set, r.k, r.g): r for r in _figures(rolled_up(moments(df, ["k", "g"], COLUMNS, PAIRS), ["k", "g"], COLUMNS, PAIRS)).collect()}
        assert len(up) == 6
        for key, own in (((2, None, None), rows), ((0, "a", None), [r for r in rows if r[0] == "a"]), ((1, None, "z"), [r for r in rows if r[1] == "z"])):
            n, std, corr = _want(own)
            assert up[key].n == n
            assert abs(up[key].std - std) < 1e-6 and abs(up[key].corr - corr) < 1e-4


def test_groups_far_from_each_other_keep_their_own_deviations(spark):
    rows = [("a", "x", 1e8 + i / 16, float(i)) for i in range(50)] + [("b", "x", i / 16, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, g string, v double, p double")
    up = _figures(rolled_up(moments(df, ["k", "g"], COLUMNS, PAIRS), ["k", "g"], COLUMNS, PAIRS)).filter("_set = 0").collect()
    want = np.std(np.arange(50) / 16, ddof=1)
    assert [round(r.std, 9) for r in up] == [round(want, 9)] * 2 and all(abs(r.corr - 1) < 1e-12 for r in up)


def test_stored_parts_merge_like_the_whole(spark, scratch):
    rows = _rows(1e8)
    kind = "k string, g string, v double, p double"
    for i in range(4):
        moments(spark.createDataFrame(rows[i::4], kind), ["k"], COLUMNS, PAIRS).write.mode("append").parquet(f"{scratch}/parts")
    got = {r.k: r for r in _figures(merged(spark.read.parquet(f"{scratch}/parts"), ["k"], COLUMNS, PAIRS)).collect()}
    whole = {r.k: r for r in _figures(moments(spark.createDataFrame(rows, kind), ["k"], COLUMNS, PAIRS)).collect()}
    for k in "ab":
        assert got[k].n == whole[k].n and abs(got[k].std - whole[k].std) < 1e-7 and abs(got[k].corr - whole[k].corr) < 1e-5


def test_constant_and_empty_columns(spark):
    kind = "k string, g string, v double, p double"
    for rows in ([("a", "x", 0.1, float(i)) for i in range(7)] + [("b", "x", 0.1, 3.0)] * 3, [("a", "x", None, 1.0)], []):
        df = spark.createDataFrame(rows, kind)
        for r in _figures(rolled_up(moments(df, ["k"], COLUMNS, PAIRS), ["k"], COLUMNS, PAIRS)).collect():
            assert r["corr"] is None and (r["std"] is None or r["std"] < 1e-12)


def test_bundles_equal_the_profile_and_the_matrix_far_from_zero(spark):
    rows = [(1e8 + (i % 7) / 100, "ABC"[i % 3], "DE"[i % 2], "IF", 10**9 + 5 * (i % 7) + i % 2, i % 2 + 1, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "carat double, cut string, color string, clarity string, price bigint, color_numeric int, clarity_numeric int")
    got = {r.analysis_type: json.loads(r.stats_json) for r in insight.all_insight_stats(df).collect()}
    stats = profile.carat_stats(df).first()
    matrix = {(r.var_x, r.var_y): r.r for r in correlation.corr_matrix(df).collect()}
    assert abs(got["Carat Analysis"]["carat_std"] - stats.carat_std) < 1e-6 and stats.carat_std > 0.019
    corr = got["Correlation Analysis"]
    for field, other in (("price_carat_corr", "carat"), ("price_color_corr", "color_numeric"), ("price_clarity_corr", "clarity_numeric")):
        assert abs(corr[field] - matrix[("price", other)]) < 1e-6
    assert abs(got["Carat Analysis"]["price_carat_correlation"] - stats.price_carat_corr) < 1e-6
