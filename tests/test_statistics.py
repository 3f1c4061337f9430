import numpy as np
import pytest
from pyspark.sql import functions as F

from gemstats.operators import category as cat
from gemstats.operators import correlation as cor
from gemstats.operators import distribution as dst
from gemstats.operators import profile as prf
from gemstats.operators import ranks

D = "carat double, cut string, color string, clarity string, price bigint, color_numeric int, clarity_numeric int"


def diamonds(spark, data):
    return spark.createDataFrame(data, D)


def row(carat=1.0, cut="Ideal", color="D", clarity="IF", price=1000, cn=1, cl=8):
    return (carat, cut, color, clarity, price, cn, cl)


def test_one_row(spark):  # E2
    df = diamonds(spark, [row()])
    s = prf.carat_stats(df).first()
    assert s.carat_std is None and s.price_carat_corr is None
    assert (s.q25, s.q50, s.q75, s.median_carat) == (1.0, 1.0, 1.0, 1.0)
    assert [r.pct for r in dst.ecdf_rows(df).collect()] == [100.0]
    h = dst.histogram(df, "carat", 30).collect()
    assert len(h) == 1 and h[0].n == 1


def test_constant_column_corr_is_null(spark):  # E3
    df = diamonds(spark, [row(carat=1.0, price=p) for p in (100, 200, 300)])
    assert prf.carat_stats(df).first().price_carat_corr is None
    m = {(r.var_x, r.var_y): r.r for r in cor.corr_matrix(df).collect()}
    assert m[("carat", "carat")] is None and m[("price", "price")] == 1.0
    assert m[("price", "carat")] is None


def test_tied_counts(spark):  # E8
    df = spark.createDataFrame([(k,) for k in "BBAACD"], "cut string").withColumn("price", F.lit(1))
    e = cat.cut_extremes(df).first()
    assert (e.most_common_cut, e.least_common_cut) == ("A", "D")


def test_pairwise_deletion(spark):  # E9
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 5.0), (3.0, None), (4.0, 1.0)], "a double, b double")
    m = {(r.var_x, r.var_y): r.r for r in cor.corr_matrix(df, ("a", "b")).collect()}
    assert m[("a", "b")] == m[("b", "a")] == pytest.approx(-0.419314, abs=1e-6)


def test_quartiles_type7(spark):  # E10
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10, 20)], "v double")
    q = ranks.exact_quantiles(df, "v", [0.25, 0.5, 0.75]).first()
    assert (q.q25, q.q50, q.q75) == (2.25, 3.5, 8.5)


def test_paradox_false_when_grade_absent(spark):  # E16
    df = diamonds(spark, [row(color="D", price=100), row(color="E", price=900)])
    p = cat.price_paradoxes(df).first()
    assert p.color_price_paradox is False and p.clarity_price_paradox is False


def test_empty_table_statistics(spark):  # E1
    df = diamonds(spark, [])
    s = cat.grade_shares(df, "cut", {"p": ["Ideal"]}).first()
    assert s.p is None
    assert cat.cut_extremes(df).count() == 1
    assert cat.cut_extremes(df).first().most_common_cut is None
    assert prf.overview_metrics(df).first().total_diamonds == 0
    assert dst.histogram(df, "carat", 30).count() == 0
    assert dst.ecdf_rows(df).count() == 0


def test_bin_edge(spark):  # E14
    df = spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "v double")
    assert df.select(dst.bin_index(F.col("v"), F.lit(0.0), F.lit(0.1)).alias("b")).collect()[1].b == 3
    h = {r.bin: r.n for r in dst.histogram(df, "v", 11).collect()}  # step 0.1 needs 11 bins
    assert h[3] == 1 and h[2] == 0 and sum(h.values()) == 3
    capped = dst.histogram(df, "v", 10).collect()  # the cap forces the next step, 0.2
    assert len(capped) == 6 and capped[1].bin_start == 0.2


def test_histogram_counts_sum_to_rows(spark):
    rng = np.random.default_rng(7)
    vals = rng.gamma(2.0, 1.3, 5000).round(2)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    h = dst.histogram(df, "v", 30).collect()
    assert sum(r.n for r in h) == 5000
    assert len(h) <= 30
    starts = [r.bin_start for r in sorted(h, key=lambda r: r.bin)]
    assert starts[0] <= vals.min() and starts[-1] <= vals.max()


def brute_cumulative(values):
    vals = np.sort(np.asarray(values))
    uniq, counts = np.unique(vals, return_counts=True)
    return dict(zip(uniq.tolist(), np.cumsum(counts).tolist())), len(vals)


@pytest.mark.parametrize("buckets", [1, 4, 64, 4096])
def test_cumulative_counts_with_hot_value(spark, buckets):
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.integers(0, 500, 4000), np.full(2000, 42)])  # one value: a third of rows
    df = spark.createDataFrame([(int(v),) for v in vals], "v bigint")
    expect, n = brute_cumulative(vals)
    got = {r.v: (r.cum, r.total) for r in ranks.cumulative_counts(df, "v", (), buckets).collect()}
    assert {k: c for k, (c, _) in got.items()} == expect
    assert {t for _, t in got.values()} == {n}


def test_grouped_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(str(g), float(v)) for g in "abc" for v in rng.normal(10, 3, 301 + ord(g)).round(1)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.q25, r.q50, r.q75) for r in
           ranks.exact_quantiles(df, "v", [0.25, 0.5, 0.75], by=("g",), buckets=8).collect()}
    for g in "abc":
        vals = np.array([v for k, v in data if k == g])
        assert got[g] == pytest.approx(tuple(np.percentile(vals, [25, 50, 75])), abs=1e-9)


def test_ecdf_rows_chunked_equals_brute_force(spark):
    vals = [1.0] * 700 + [2.0] * 5 + [0.5] * 3
    df = spark.createDataFrame([(v,) for v in vals], "carat double")
    got = sorted((r.carat, r.position, r.pct) for r in dst.ecdf_rows(df, chunk=64, partitions=4).collect())
    s = sorted(vals)
    expect = [(v, i + 1, round((i + 1) / len(s) * 100, 6)) for i, v in enumerate(s)]
    assert got == expect


def test_ecdf_monotone_and_ends_at_100(spark):
    from tests.conftest import SF_SMALL
    from gemstats.operators.clean import clean
    from gemstats.sources.fixture import diamond_raw
    e = sorted((r.carat, r.pct) for r in dst.ecdf_values(clean(diamond_raw(spark, SF_SMALL))).collect())
    pcts = [p for _, p in e]
    assert pcts == sorted(pcts) and pcts[-1] == 100.0


def test_correlation_matrix_symmetric_and_bounded(spark):
    from tests.conftest import SF_SMALL
    from gemstats.operators.clean import clean
    from gemstats.sources.fixture import diamond_raw
    m = {(r.var_x, r.var_y): r.r for r in cor.corr_matrix(clean(diamond_raw(spark, SF_SMALL))).collect()}
    assert len(m) == 16
    for (a, b), r in m.items():
        assert r == m[(b, a)]
        assert -1.0 <= r <= 1.0


def test_corr_skipped_without_derived_columns(spark):  # COR-5
    df = spark.createDataFrame([(1.0, 2)], "carat double, price bigint")
    assert cor.corr_matrix(df).count() == 0


def test_box_stats_brute_force(spark):
    vals = [1, 2, 3, 4, 10, 20, 100]
    df = spark.createDataFrame([("a", v) for v in vals], "clarity string, price bigint")
    b = dst.box_stats(df).first()
    q1, q3 = np.percentile(vals, [25, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in vals if lo <= v <= hi]
    assert (b.q1, b.q3) == (q1, q3)
    assert (b.whisker_low, b.whisker_high) == (min(inside), max(inside))
    assert b.outliers == len(vals) - len(inside)
    assert [r.price for r in dst.box_outliers(df).collect()] == [v for v in vals if v < lo or v > hi]


def test_quartiles_type5_and_approx(spark):  # E10, second method; the sketch option
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10, 20)], "v double")
    q = ranks.quantiles(df, "v", [0.25, 0.5, 0.75], method="hazen").first()
    assert (q.q25, q.q50, q.q75) == (2.0, 3.5, 10.0)
    a = ranks.quantiles(df, "v", [0.25, 0.5, 0.75], method="approx").first()
    assert a.q25 in (1.0, 2.0, 3.0) and a.q75 in (4.0, 10.0, 20.0)
    vals = [1, 2, 3, 4, 10, 20, 100]
    box = spark.createDataFrame([("a", v) for v in vals], "clarity string, price bigint")
    h = dst.box_stats(box, method="hazen").first()
    assert (h.q1, h.median, h.q3) == tuple(np.percentile(vals, [25, 50, 75], method="hazen"))


def test_many_small_groups_exact_quartiles(spark):
    """1,500 groups of 1-4 values next to one large group: every group's
    type-7 quartiles equal numpy's, and no group carries more distinct
    edges than it has distinct values."""
    rng = np.random.default_rng(11)
    data = [(f"g{g}", float(rng.integers(0, 5))) for g in range(1500) for _ in range(1 + g % 4)]
    data += [("big", float(v)) for v in rng.integers(0, 3000, 5000)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.q1, r.q2, r.q3) for r in
           ranks.exact_quantiles(df, "v", [0.25, 0.5, 0.75], ["q1", "q2", "q3"], by=("k",), buckets=64).collect()}
    groups = {}
    for k, v in data:
        groups.setdefault(k, []).append(v)
    assert len(got) == len(groups)
    for k, vals in groups.items():
        want = np.percentile(vals, [25, 50, 75])
        assert got[k] == pytest.approx(tuple(want), abs=1e-9), k
    plan = ranks.cumulative_counts(df, "v", ("k",))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan and "percentile" not in plan


@pytest.mark.parametrize("values", [[-1.0, 1.0], [-3.0, 5.0], [-1e-9, 1e9], [0.0, 7.0, 7.0], [5.0], [-0.3, 0.1, 1e6]])
@pytest.mark.parametrize("bins", [1, 2, 3, 30])
def test_histogram_is_never_empty(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in [*values, float("inf"), float("-inf"), None]], "v double")
    got = sorted(dst.histogram(df, "v", bins).collect())
    assert 1 <= len(got) <= bins
    assert sum(r.n for r in got) == len(values)
    assert all(r.bin_start is not None and r.bin_start == r.bin_start for r in got)
    assert got[0].bin_start <= min(values) + 1e-6 and got[-1].bin_end >= max(values) - 1e-6


def test_extremes_skip_keys_without_a_price(spark):
    df = spark.createDataFrame([("Good", 10.0), ("Ideal", 20.0), ("Fair", None)], "cut string, price double")
    r = cat.cut_extremes(df).first()
    assert (r.highest_priced_cut, r.lowest_priced_cut) == ("Ideal", "Good")
    none = cat.cut_extremes(df.filter("cut = 'Fair'")).first()
    assert none.highest_priced_cut is None and none.most_common_cut == "Fair"


def test_box_plans_never_deal_rows_by_the_group(spark):
    """With any table too big to broadcast by size alone, rows stay where they are."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        df = spark.range(20000).selectExpr("concat('k', id % 3) AS clarity", "id * 7 % 1999 + if(id % 500 = 0, 90000, 0) AS price")
        out = dst.box_outliers(df, "price", "clarity")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(clarity" not in plan
        assert "BuildRight" in plan and out.count() == 40
        assert "SortMergeJoin" not in dst.box_stats(df, "price", "clarity")._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in __import__("gemstats.operators.insight", fromlist=["x"]).insight_stats(
            df.selectExpr("1.0D AS carat", "price", "clarity"), "Clarity Analysis")._jdf.queryExecution().executedPlan().toString().split("HashAggregate(keys=[clarity")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_attach_splits_keys_when_the_side_is_large(spark):
    from gemstats.operators.attach import attach
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS k", "id AS v")
    side = rows.groupBy("k").agg(F.max("v").alias("m"))
    want = {(r.k, r.v, r.m) for r in rows.join(side, "k").collect()}
    out = attach(rows, side, ["k"], max_rows=10)
    assert {(r.k, r.v, r.m) for r in out.collect()} == want
    assert "_salt" in out._jdf.queryExecution().executedPlan().toString()
