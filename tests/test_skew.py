"""A third of all rows on one row / one key / one value: results stay exact."""

import numpy as np
from pyspark.sql import functions as F

from gemstats.operators import category as cat
from gemstats.operators import clean as cln
from gemstats.operators import distribution as dst

S = "carat double, cut string, color string, clarity string, price bigint, x double, y double, z double"


def skewed(spark):
    rng = np.random.default_rng(5)
    rows = [(float(round(rng.uniform(0.2, 3.0), 1)), ["Fair", "Good", "Ideal"][i % 3], "DEFGHIJ"[i % 7],
             ["SI1", "VS2", "IF"][i % 3], int(300 + i), 1.0, 1.0, 1.0) for i in range(4000)]
    hot = [(1.0, "Ideal", "E", "VS2", 999, 1.0, 1.0, 1.0)] * 2000  # one row copied: a third of all rows
    return spark.createDataFrame(rows + hot, S).repartition(6)


def test_hot_duplicate_row_dedup(spark):
    c = cln.clean(skewed(spark))
    assert c.count() == 4001
    assert c.filter((F.col("price") == 999) & (F.col("carat") == 1.0)).count() == 1


def test_hot_key_profile_and_shares(spark):
    raw = skewed(spark)
    prof = {r.cut: r.n for r in cat.category_profile(raw, "cut").collect()}
    assert prof["Ideal"] == 4000 // 3 + 2000 and sum(prof.values()) == 6000
    s = cat.grade_shares(raw, "cut", {"p": ["Ideal"]}).first().p
    assert s == round(prof["Ideal"] / 6000 * 100, 6)


def test_hot_value_distributions(spark):
    raw = skewed(spark)
    vals = np.array([r.carat for r in raw.select("carat").collect()])
    h = dst.histogram(raw, "carat", 30).collect()
    assert sum(r.n for r in h) == 6000
    e = {r.carat: r.pct for r in dst.ecdf_values(raw).collect()}
    assert e[1.0] == round(float((vals <= 1.0).mean() * 100), 6)
    rows = dst.ecdf_rows(raw, chunk=256, partitions=5)
    assert rows.count() == 6000
    assert rows.agg(F.countDistinct("position")).first()[0] == 6000
    b = {r.clarity: r for r in dst.box_stats(raw).collect()}
    prices = np.array([r.price for r in raw.filter(F.col("clarity") == "VS2").collect()])
    assert b["VS2"].median == float(np.percentile(prices, 50))
