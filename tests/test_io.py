import os

from pyspark.sql import types as T

from gemstats.sources.files import NA_TOKENS, format_of, parse_columns, read_table, write_csv


def write_text(path, text):
    with open(path, "w") as fh:
        fh.write(text)


def test_missing_tokens(spark, scratch):  # E5
    p = os.path.join(scratch, "d.csv")
    write_text(p, "carat,price,cut\nNA,1,Ideal\nNone,2,Good\n,3,Fair\nnan,4,Good\n1.5,5,NA\n")
    df = read_table(spark, p)
    assert dict(df.dtypes) == {"carat": "double", "price": "bigint", "cut": "string"}
    rows = sorted(df.collect(), key=lambda r: r.price)
    assert [r.carat for r in rows] == [None, None, None, None, 1.5]
    assert rows[-1].cut is None


def test_blank_index_header_dropped_by_clean(spark, scratch):  # E6
    from gemstats.operators.clean import clean
    p = os.path.join(scratch, "i.csv")
    write_text(p, ",carat,cut,color,clarity,price\n0,1.0,Good,E,SI1,400\n1,1.0,Good,E,SI1,400\n")
    df = read_table(spark, p)
    assert "_c0" in df.columns
    assert clean(df).count() == 1


def test_schema_given(spark, scratch):
    p = os.path.join(scratch, "s.csv")
    write_text(p, "carat,price\n1.0,10\nbad,20\n")
    schema = T.StructType([T.StructField("carat", T.DoubleType()), T.StructField("price", T.LongType())])
    rows = sorted(read_table(spark, p, schema=schema).collect(), key=lambda r: r.price)
    assert [(r.carat, r.price) for r in rows] == [(1.0, 10), (None, 20)]


def test_parquet_and_csv_round_trip(spark, scratch):
    df = spark.createDataFrame([(1.0, "a", 3), (None, "b", 4)], "x double, s string, n bigint")
    out = os.path.join(scratch, "rt_csv")
    write_csv(df, out)
    back = read_table(spark, out, fmt="csv")
    assert sorted(back.collect(), key=lambda r: r.n) == sorted(df.collect(), key=lambda r: r.n)
    pq = os.path.join(scratch, "rt.parquet")
    df.write.parquet(pq)
    assert sorted(read_table(spark, pq).collect(), key=lambda r: r.n) == sorted(df.collect(), key=lambda r: r.n)


def test_format_of():
    assert format_of("/a/b.CSV") == "csv" and format_of("x.parquet") == "parquet"


def test_token_list_is_plain():
    assert "NA" in NA_TOKENS and "" in NA_TOKENS and "nan" in NA_TOKENS


def test_parse_columns_nan_to_null(spark):
    df = spark.createDataFrame([("NaN",), ("2.5",), ("inf",)], "v string")
    vals = [r.v for r in parse_columns(df, {"v": T.DoubleType()}).collect()]
    assert vals[0] is None and vals[1] == 2.5


def test_quoted_cells(spark, scratch):
    p = os.path.join(scratch, "q.csv")
    write_text(p, 'cut,note,price\n"Very Good","say ""hi"", ok",5\n')
    r = read_table(spark, p).first()
    assert (r.cut, r.note, r.price) == ("Very Good", 'say "hi", ok', 5)


def test_codes_are_not_numbers(spark, scratch):
    p = os.path.join(scratch, "codes.csv")
    write_text(p, "code,n,f\n1D,1,1.5\n2F, 2,-.5e3\n3D,+3,inf\n")
    df = read_table(spark, p)
    assert dict(df.dtypes) == {"code": "string", "n": "bigint", "f": "double"}
    assert sorted(r.code for r in df.collect()) == ["1D", "2F", "3D"]


def test_cells_that_fail_are_counted_and_other_columns_stay(spark, scratch):
    from gemstats.sources.files import parse_failures, read_csv_text
    p = os.path.join(scratch, "f.csv")
    write_text(p, "carat,price,note\n1.0,12a,x\n1.5D,NA,y\n2.0,30,z\n")
    schema = T.StructType([T.StructField("carat", T.DoubleType()), T.StructField("price", T.LongType())])
    df = read_table(spark, p, schema=schema)
    assert df.columns == ["carat", "price", "note"] and df.count() == 3
    got = {r.column: (r.failed, r.example) for r in parse_failures(read_csv_text(spark, p), {f.name: f.dataType for f in schema.fields}).collect()}
    assert got == {"carat": (1, "1.5D"), "price": (1, "12a")}
    import pytest
    with pytest.raises(ValueError, match="depth"):
        read_table(spark, p, schema=T.StructType([T.StructField("depth", T.DoubleType())]))
