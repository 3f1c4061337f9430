import csv
import random

import pytest

from gemstats.operators import clean as cln
from gemstats.sources.files import infer_types, read_csv_text, read_table, write_csv
from gemstats.sources.order import ORDINAL
from gemstats.sources import records
from gemstats.sources.records import has_line_breaks, numbered_records, read_records
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = ["a", "b c", 'say "hi"', "x,y", "two\nlines", 'q"u\no"te', "", '5" pipe', "\n\n", '"', "a\r\nb", "long " * 30, '","', '\n"\n']


@pytest.fixture()
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_cells_with_line_breaks_over_many_blocks_and_files(spark, scratch, small_blocks):
    rnd, rows = random.Random(1), []
    for name in ("a", "b"):
        own = [[f"{name}{i}", rnd.choice(CELLS), rnd.choice(CELLS)] for i in range(600)]
        with open(f"{scratch}/{name}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\r\n" if name == "b" else "\n")
            w.writerow(["id", "u", "u"])
            w.writerows(own)
            f.write(f'{name}x,5" pipe,plain\n')  # a quote that opens nothing
        rows += [*own, [f"{name}x", '5" pipe', "plain"]]
    assert has_line_breaks(spark, scratch)
    assert spark.read.option("lineSep", "\n").text(scratch).rdd.getNumPartitions() > 10
    df = read_records(spark, scratch, ordered=True)
    got = [tuple(r) for r in df.orderBy(ORDINAL).collect()]
    assert df.columns == ["id", "u1", "u2", ORDINAL]
    assert got == [(*[c or None for c in r], i) for i, r in enumerate(rows)]


def test_lines_of_one_block_are_summed_by_several_tasks(spark, scratch, monkeypatch):
    rnd = random.Random(3)
    rows = [[f"r{i}", rnd.choice(CELLS), rnd.choice(CELLS)] for i in range(900)]
    with open(f"{scratch}/a.csv", "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "u", "v"])
        w.writerows(rows)
    monkeypatch.setattr(records, "PIECE", 37)
    monkeypatch.setattr(records, "TASK_LINES", 100)
    lines = records.written(records._lines(spark, scratch))
    assert lines.select("file", "block").distinct().count() == 1
    held = [r["count"] for r in records._dealt(lines).groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) < sum(held) / 4
    got = [tuple(r) for r in read_records(spark, scratch, ordered=True).orderBy(ORDINAL).collect()]
    assert got == [(*[c or None for c in r], i) for i, r in enumerate(rows)]


def test_plain_files_use_the_plain_reader_in_file_order(spark, scratch, small_blocks):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", 'q"uote', "x, y", 'all "of" it'])) for i in range(2000)]
    with open(f"{scratch}/t.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", "c"])
        w.writerows(rows)
    assert not has_line_breaks(spark, scratch)
    got = [(r.id, r.c) for r in read_table(spark, f"{scratch}/t.csv", ordered=True).orderBy(ORDINAL).collect()]
    assert got == rows
    assert read_csv_text(spark, f"{scratch}/t.csv").columns == ["id", "c"]


def test_an_open_quote_is_refused(spark, scratch):
    with open(f"{scratch}/t.csv", "w") as f:
        f.write('a,b\n1,"two\n3,4\n')
    with pytest.raises(ValueError, match="inside a quoted cell"):
        numbered_records(spark, scratch)


def test_written_tables_come_back(spark, scratch):
    rows = [(1, ' "a", \n\n b '), (2, "plain "), (3, None)]
    write_csv(spark.createDataFrame(rows, "id int, c string").coalesce(1), f"{scratch}/t")
    back = read_table(spark, f"{scratch}/t", "csv", ordered=True)
    assert [(r.id, r.c) for r in back.orderBy(ORDINAL).collect()] == rows


def test_types_from_one_classification(spark):
    columns = {"i": ["1", " 2 ", "-3"], "d": ["1", "2.5", "1e3"], "big": ["1", "99999999999999999999", "2"], "t": ["True", "false", None],
               "mixed": ["True", "1", None], "s": ["1", "x", None], "dd": ["1D", "2", "3"], "none": [None] * 3}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} string" for c in columns))
    want = {"i": T.LongType(), "d": T.DoubleType(), "big": T.DoubleType(), "t": T.BooleanType(), "mixed": T.StringType(),
            "s": T.StringType(), "dd": T.StringType(), "none": T.LongType()}
    assert infer_types(df) == want


def test_first_copies_keep_their_place(spark, scratch):
    with open(f"{scratch}/t.csv", "w") as f:
        f.write("carat,cut,color,clarity,price\n" + "".join(f"{c},Ideal,E,{k},{p}\n" for c, k, p in (
            (3, "VS1", 9), (1, "IF", 5), (3, "VS1", 9), (2, "VS1", 1), (1, "IF", 5), (0.5, "I1", 7))))
    df = cln.clean(read_table(spark, f"{scratch}/t.csv", ordered=True))
    assert [r.carat for r in cln.preview(df, 3).collect()] == [3.0, 1.0, 2.0]
    from gemstats.operators import filters as flt
    assert [r.value for r in flt.filter_options(df).collect() if r.dimension == "clarity"] == ["VS1", "IF", "I1"]
    assert [(r.pos, r.price) for r in flt.available(df, 3).collect()] == [(1, 9), (2, 5), (3, 1)]
    assert ORDINAL not in flt.listing(df).columns
