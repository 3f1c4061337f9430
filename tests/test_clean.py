import math

from pyspark.sql import functions as F

from gemstats.operators import clean as cln
from gemstats.sources.fixture import diamond_raw

SCHEMA = "carat double, cut string, color string, clarity string, price bigint, x double, y double, z double"


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def test_empty_table(spark):  # E1
    df = cln.clean(frame(spark, []))
    assert df.count() == 0
    assert cln.quality_report(df).first().asDict() == {"rows": 0, "columns": 11, "missing_values": 0}


def test_nan_and_null_dropped(spark):  # E4
    df = frame(spark, [(float("nan"), "Ideal", "D", "IF", 500, 1.0, 1.0, 1.0),
                       (None, "Ideal", "D", "IF", 500, 1.0, 1.0, 1.0),
                       (1.0, "Ideal", "D", "IF", 500, 1.0, 1.0, 1.0)])
    out = cln.clean(df)
    assert [r.carat for r in out.collect()] == [1.0]
    avg = out.agg(F.avg("carat")).first()[0]
    assert not math.isnan(avg)


def test_index_column_dropped_before_dedup(spark):  # E6
    df = spark.createDataFrame([(0, 1.0, "Good", "E", "SI1", 400, 1.0, 1.0, 1.0),
                                (1, 1.0, "Good", "E", "SI1", 400, 1.0, 1.0, 1.0)],
                               "_c0 int, " + SCHEMA)
    out = cln.clean(df)
    assert "_c0" not in out.columns
    assert out.count() == 1


def test_unmapped_grade_row_stays(spark):  # E7
    df = frame(spark, [(1.0, "Super", "K", "IF", 500, 1.0, 1.0, 1.0)])
    out = cln.clean(df)
    r = out.first()
    assert (r.color_numeric, r.clarity_numeric, r.cut_gia) == (None, 8, None)
    assert cln.quality_report(out).first().missing_values == 2


def test_dimensions_optional(spark):  # E15
    df = spark.createDataFrame([(1.0, "Fair", "J", "I1", 300)],
                               "carat double, cut string, color string, clarity string, price bigint")
    out = cln.clean(df)
    assert out.first().asDict() == {"carat": 1.0, "cut": "Fair", "color": "J", "clarity": "I1", "price": 300,
                                    "color_numeric": 7, "clarity_numeric": 1, "cut_gia": "Poor"}


def test_bad_dimensions_dropped(spark):
    df = frame(spark, [(1.0, "Good", "E", "SI1", 400, 0.0, 1.0, 1.0),
                       (1.0, "Good", "E", "SI1", 400, 1.0, -1.0, 1.0),
                       (1.0, "Good", "E", "SI1", 400, 1.0, 1.0, 1.0)])
    assert cln.clean(df).count() == 1


def test_negative_zero_is_a_duplicate(spark):
    df = frame(spark, [(1.0, "Good", "E", "SI1", 400, 1.0, 1.0, 0.5),
                       (1.0, "Good", "E", "SI1", 400, 1.0, 1.0, 0.5)])
    assert cln.clean(df).count() == 1


def test_all_grade_maps(spark):
    data = [(1.0, cut, color, clarity, 100, 1.0, 1.0, 1.0)
            for cut, color, clarity in zip(["Fair", "Good", "Very Good", "Premium", "Ideal", "Ideal", "Ideal", "Ideal"],
                                           ["D", "E", "F", "G", "H", "I", "J", "J"],
                                           ["I1", "SI2", "SI1", "VS2", "VS1", "VVS2", "VVS1", "IF"])]
    out = {(r.color, r.clarity, r.cut): (r.color_numeric, r.clarity_numeric, r.cut_gia)
           for r in cln.clean(frame(spark, data)).collect()}
    assert out[("D", "I1", "Fair")] == (1, 1, "Poor")
    assert out[("G", "VS2", "Premium")] == (4, 4, "Excellent")
    assert out[("J", "IF", "Ideal")] == (7, 8, "Excellent")
    assert out[("F", "SI1", "Very Good")] == (3, 3, "Very Good")


def test_clean_is_idempotent_on_input_columns(spark):
    from tests.conftest import SF_SMALL
    once = cln.clean(diamond_raw(spark, SF_SMALL))
    twice = cln.clean(once.drop(*cln.DERIVED))
    assert once.count() == twice.count() == 5964
    assert once.exceptAll(twice).count() == 0


def test_fixture_counts_match_survey(spark):
    from tests.conftest import SF_SMALL
    raw = diamond_raw(spark, SF_SMALL)
    assert raw.count() == 6116
    assert raw.distinct().count() == 6000
    assert cln.clean(raw).count() == 5964


def test_preview_first_rows_in_order(spark):
    df = frame(spark, [(2.0, "Good", "E", "SI1", 400, 1.0, 1.0, 1.0),
                       (1.0, "Good", "E", "SI1", 400, 1.0, 1.0, 1.0)])
    assert [r.carat for r in cln.preview(cln.clean(df), 1).collect()] == [1.0]
