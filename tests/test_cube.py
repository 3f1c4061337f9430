import random

from gemstats.operators import filters as flt
from gemstats.operators.cube import FilterCube, _bin_sql


def test_counts_equal_the_filter_for_any_sliders(spark, scratch):
    rnd = random.Random(1)
    rows = [(rnd.choice([0.3, 0.5, 1.0, 1.5, 2.0]) + rnd.randint(0, 9) / 100, rnd.choice(["Ideal", "Good"]), rnd.choice("DEF"),
             rnd.choice(["IF", "VS1"]), rnd.choice([rnd.randint(100, 5000), 1000, 4000])) for _ in range(4000)] + [(None, "Good", "D", "IF", 5)]
    df = spark.createDataFrame(rows, "carat double, cut string, color string, clarity string, price bigint")
    cube = FilterCube.build(df, f"{scratch}/cube", bins=8)
    edge = cube.edges
    ranges = [None, (1000, 4000), (0, 99), (100, 5000), (1000, 1000), (4000, 1000), (None, 2500), (2500, None), (edge["price"][0], edge["price"][-1])]
    for price in ranges:
        carat = rnd.choice([None, (0.5, 2.0), (0.35, 1.02), (None, 1.0), (edge["carat"][0], None), (3.0, 9.0)])
        kw = {"price": price, "carat": carat, "colors": rnd.choice([["D", "E"], ["F"], ["D", "E", "F"]])}
        want = flt.filter_counts(df.na.drop(), flt.diamond_predicate(**kw)).first()
        got = cube.counts(**kw).first()
        assert got.n_filtered == want.n_filtered, kw
        assert got.n_total == 4001


def test_only_cut_bins_are_read(spark, scratch):
    rows = [(i % 97 / 10, "Ideal", "D", "IF", i) for i in range(6400)]
    df = spark.createDataFrame(rows, "carat double, cut string, color string, clarity string, price bigint")
    cube = FilterCube.build(df, f"{scratch}/cube")
    read = cube.spark.read.parquet(f"{cube.path}/by_pb").filter(f"pb in ({', '.join(map(str, cube._bins('price', (1000, 4000))[2]))})").count()
    assert read <= 2 * 6400 / 64 + 20


def test_halving_finds_the_bin(spark):
    edges = [1.0, 2.0, 5.0]
    got = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 4.9, 5.0, 9.0)], "v double").selectExpr(f"{_bin_sql('v', edges)} AS b").collect()
    assert [r.b for r in got] == [0, 1, 1, 2, 2, 3, 3]
