import glob
import os

import pytest
from pyspark.sql import functions as F

from gemstats.operators import commits, numbering
from gemstats.sources.order import ORDINAL
from gemstats.operators import filters as flt
from gemstats.operators import inventory as inv
from gemstats.operators.clean import clean

S = "carat double, cut string, color string, clarity string, price bigint, x double, y double, z double"


def cleaned(spark, data):
    return clean(spark.createDataFrame(data, S))


def stone(carat=1.0, cut="Ideal", color="D", clarity="IF", price=1000):
    return (carat, cut, color, clarity, price, 1.0, 1.0, 1.0)


def test_empty_member_list_keeps_nothing(spark):  # E11
    df = cleaned(spark, [stone()])
    assert flt.apply_filters(df, colors=[]).count() == 0
    assert flt.apply_filters(df, colors=None).count() == 1


def test_inclusive_bounds(spark):  # E12
    df = cleaned(spark, [stone(price=100), stone(price=200), stone(price=300)])
    assert sorted(r.price for r in flt.apply_filters(df, price=(100, 300)).collect()) == [100, 200, 300]
    assert flt.apply_filters(df, price=(101, 299)).count() == 1


def test_fractional_price_bounds(spark):  # E13
    df = spark.createDataFrame([(1.0, 100.0), (2.0, 18823.7)], "carat double, price double")
    b = flt.filter_bounds(df).first()
    assert (b.price_min, b.price_max) == (100, 18823)
    assert flt.apply_filters(df).count() == 2


def test_options_and_counts(spark):
    df = cleaned(spark, [stone(color="E", clarity="VS1"), stone(color="D", clarity="IF", cut="Good")])
    opts = [(r.dimension, r.value) for r in flt.filter_options(df).collect()]
    assert opts == [("clarity", "IF"), ("clarity", "VS1"), ("color", "D"), ("color", "E"),
                    ("cut", "Ideal"), ("cut", "Good")]
    c = flt.filter_counts(df, flt.diamond_predicate(colors=["D"])).first()
    assert (c.n_filtered, c.n_total) == (1, 2)


def test_listing_and_labels(spark):
    df = cleaned(spark, [stone(carat=c / 10, price=1000 + c) for c in range(1, 200)])
    listed = flt.available(df).collect()
    assert [r.pos for r in listed] == list(range(1, 101))
    assert listed[0].carat == 0.1
    lab = flt.item_labels(df, 3).collect()
    assert lab[0].label == "Diamond 1: 0.10ct, D-IF, $1,001"


def test_ragged_append(spark):  # E17
    df = cleaned(spark, [stone()])
    led = inv.Ledger(spark).add_all(df).add_manual(1.5, "Good", "E", "VS1", 4000)
    cur = {r.op: r for r in led.current().collect()}
    assert cur["all"].x == 1.0 and cur["all"].color_numeric == 1
    assert cur["manual"].x is None and cur["manual"].color_numeric is None and cur["manual"].price == 4000


def test_repeat_append_is_a_bag(spark):  # E18
    df = cleaned(spark, [stone(price=p) for p in (100, 200)])
    led = inv.Ledger(spark).add_all(df).add_all(df)
    t = led.totals().first()
    assert (t.items, t.total_value, t.avg_price) == (4, 600, 150.0)


def test_clear_then_add(spark):  # E19
    df = cleaned(spark, [stone(price=p) for p in (100, 200, 300)])
    led = inv.Ledger(spark).add_all(df).clear().add_manual(1.0, "Ideal", "D", "IF", 500)
    assert led.current().count() == 1
    assert led.totals().first().total_value == 500


def test_empty_inventory_totals(spark):
    t = inv.Ledger(spark).totals().first()
    assert (t.items, t.total_value, t.avg_price) == (0, None, None)


def test_manual_entry_rejected(spark):  # E20
    with pytest.raises(ValueError, match="carat out of range"):
        inv.Ledger(spark).add_manual(12.0, "Ideal", "D", "IF", 5000)
    bad = spark.createDataFrame([(12.0, "Ideal", "Z", "IF", 50)],
                                "carat double, cut string, color string, clarity string, price bigint")
    r = inv.validate_manual(bad).first()
    assert r.valid is False
    assert r.reason == "carat out of range; price out of range; unknown color"


def test_select_by_position_and_key(spark):
    df = cleaned(spark, [stone(carat=c / 10) for c in range(1, 20)])
    listed = flt.listing(df)
    led = inv.Ledger(spark).add_selected(listed, [1, 3])
    assert sorted(r.carat for r in led.current().collect()) == [0.1, 0.3]
    keys = led.current().select("row_id")
    again = inv.Ledger(spark).add_keys(df, keys)
    assert sorted(r.carat for r in again.current().collect()) == [0.1, 0.3]


def test_ledger_save_load_replay(spark, scratch):
    df = cleaned(spark, [stone(price=p) for p in (100, 200, 300)])
    path = os.path.join(scratch, "ledger")
    led = inv.Ledger(spark).add_all(df).save(path)
    led = led.clear().add_manual(1.0, "Ideal", "D", "IF", 700).save(path)
    back = inv.Ledger.load(spark, path)
    assert back.next_batch == 4 and back.last_clear == 2
    assert back.current().drop("row_id").collect() == led.current().drop("row_id").collect()
    assert back.events.count() == 5  # 3 rows, 1 clear marker, 1 manual row: nothing written twice


def test_export_csv_round_trip(spark, scratch):
    from gemstats.sources.files import read_table
    df = cleaned(spark, [stone(price=p) for p in (100, 200)])
    led = inv.Ledger(spark).add_all(df).add_manual(1.0, "Good", "E", "VS1", 300)
    out = os.path.join(scratch, "inventory_csv")
    inv.export_csv(led.current(), out)
    assert glob.glob(os.path.join(out, "*.csv"))
    back = read_table(spark, out, fmt="csv")
    assert sorted(r.price for r in back.collect()) == [100, 200, 300]
    assert "batch_id" not in back.columns and "row_id" not in back.columns
    assert back.filter(F.col("x").isNull()).count() == 1


def test_manual_checks_agree_with_table_checks(spark):
    entries = [(12.0, "Ideal", "Z", "IF", 50), (1.0, "Ideal", "D", "IF", 500), (0.1, "Fair", "J", "I1", 100),
               (10.0, "Super", "D", "XX", 100000), (None, "Good", "E", "VS1", 300), (0.09, None, "K", "SI2", 100001)]
    df = spark.createDataFrame(entries, "carat double, cut string, color string, clarity string, price bigint")
    got = {tuple(r[:5]): r.reason for r in inv.validate_manual(df).collect()}
    for e in entries:
        problems = inv.manual_problems(dict(zip(["carat", "cut", "color", "clarity", "price"], e)))
        assert ("; ".join(problems) or None) == got[e]


def test_current_skips_batches_before_the_last_clear(spark):
    df = cleaned(spark, [stone(price=p) for p in (100, 200)])
    led = inv.Ledger(spark).add_all(df).add_all(df).clear().add_all(df).clear()
    assert led.current().count() == 0 and led.events.count() == 8
    plan = led.add_manual(1.0, "Ideal", "D", "IF", 500).current()._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan  # the manual row is a literal, not a Python-side scan


def wide(spark):
    rows = [(1.0, "Ideal", "D", "IF", 100.75, 61.5, "a"), (1.0, "Ideal", "D", "IF", 100.75, 62.0, "b"), (1.2, "Good", "E", "VS1", 200.5, None, "c")]
    return spark.createDataFrame(rows, "carat double, cut string, color string, clarity string, price double, depth double, note string")


def test_ledger_keeps_all_columns_and_cents(spark, scratch):
    led = inv.Ledger(spark).add_all(wide(spark)).add_manual(1.0, "Ideal", "D", "IF", 500)
    cur = led.current()
    assert {"depth", "note"} <= set(cur.columns) and cur.schema["price"].dataType.simpleString() == "double"
    assert sorted(r.price for r in cur.collect()) == [100.75, 100.75, 200.5, 500.0]
    assert cur.select("row_id").distinct().count() == 4
    t = led.totals().first()
    assert (t.items, t.total_value, t.avg_price) == (4, 902.0, 225.5)
    back = inv.Ledger.load(spark, led.save(os.path.join(scratch, "wide")).path)
    assert sorted(map(str, back.current().collect())) == sorted(map(str, cur.collect()))


def test_ledger_widens_by_name_after_a_save(spark, scratch):
    df = cleaned(spark, [stone(price=p) for p in (100, 200)])
    path = os.path.join(scratch, "narrow")
    led = inv.Ledger(spark).add_all(df).save(path).add_all(df.withColumn("note", F.lit("n"))).save(path)
    back = inv.Ledger.load(spark, path).current()
    assert sorted(str(r.note) for r in back.collect()) == ["None", "None", "n", "n"]
    with pytest.raises(ValueError, match="widened"):
        led.add_manual(1.0, "Ideal", "D", "IF", 500.25).save(path)
    assert led.add_manual(1.0, "Ideal", "D", "IF", 500.25).save(path + "2").totals().first().total_value == 1100.25
    with pytest.raises(ValueError, match="note"):
        led.add_all(df.withColumn("note", F.lit(1)))


def test_save_to_another_path_carries_the_stored_part(spark, scratch):
    df = cleaned(spark, [stone(price=p) for p in (100, 200, 300)])
    one, two = os.path.join(scratch, "one"), os.path.join(scratch, "two")
    led = inv.Ledger(spark).add_all(df).save(one).add_manual(1.0, "Ideal", "D", "IF", 500).save(two)
    assert led.current().count() == 4 and inv.Ledger.load(spark, two).current().count() == 4
    with pytest.raises(ValueError, match="another ledger"):
        inv.Ledger(spark).add_all(df).save(two)


def test_empty_saves_and_empty_batches_keep_their_numbers(spark, scratch):
    df = cleaned(spark, [stone(price=100)])
    path = os.path.join(scratch, "empty")
    led = inv.Ledger(spark).save(path)
    assert led.current().count() == 0 and inv.Ledger.load(spark, path).next_batch == 1
    led = led.add_all(df).add_all(df.filter("price > 1000")).save(path)
    back = inv.Ledger.load(spark, path)
    assert back.next_batch == 3 and back.current().count() == 1 and back.events.count() == 1
    small = back.add_all(df).clear().add_all(df).compact(os.path.join(scratch, "compact"))
    assert small.current().count() == 1 and small.events.count() == 1


def test_picks_by_key_survive_a_change_of_filters(spark):
    df = cleaned(spark, [stone(carat=c / 10, price=100 * c) for c in range(1, 20)])
    key = inv.Ledger(spark).add_selected(flt.listing(df.filter("price > 500")), [2]).current().select("row_id")
    again = inv.Ledger(spark).add_keys(df.filter("price < 900"), key).current().first()
    assert again.carat == 0.7


def test_two_sessions_on_one_ledger(spark, scratch):
    df = cleaned(spark, [stone(price=p) for p in (100, 200, 300)])
    path = os.path.join(scratch, "shared")
    inv.Ledger(spark).add_all(df).save(path)
    one, two = inv.Ledger.load(spark, path), inv.Ledger.load(spark, path)
    one = one.add_manual(1.0, "Ideal", "D", "IF", 700).add_all(df.filter("price = 100")).save(path)
    two = two.add_manual(1.0, "Good", "E", "VS1", 900).save(path)
    assert (one.next_batch, two.next_batch) == (4, 5)
    rows = {(r.batch_id, r.op, r.price) for r in two.current().collect()}
    assert rows == {(1, "all", 100), (1, "all", 200), (1, "all", 300), (2, "manual", 700), (3, "all", 100), (4, "manual", 900)}
    one.clear().save(path)
    assert inv.Ledger.load(spark, path).current().count() == 0


def test_a_taken_number_is_tried_again(spark, scratch, monkeypatch):
    df = cleaned(spark, [stone(price=100)])
    path = os.path.join(scratch, "race")
    inv.Ledger(spark).add_all(df).save(path)
    late = inv.Ledger.load(spark, path).add_all(df)
    stale, calls = commits.read_commits(spark, path), []
    inv.Ledger.load(spark, path).add_manual(1.0, "Ideal", "D", "IF", 700).save(path)

    def read(s, p):
        calls.append(p)
        return stale if len(calls) == 1 else commits.read_commits(s, p)

    monkeypatch.setattr(inv, "read_commits", read)
    assert sorted((r.batch_id, r.op) for r in late.save(path).current().collect()) == [(1, "all"), (2, "manual"), (3, "all")]
    assert not commits.try_commit(spark, path, 3, {}) and len(commits.read_commits(spark, path)) == 3


def test_a_save_that_breaks_off_is_not_seen(spark, scratch, monkeypatch):
    df = cleaned(spark, [stone(price=p) for p in (100, 200)])
    path = os.path.join(scratch, "broken")
    inv.Ledger(spark).add_all(df).save(path)

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(inv, "try_commit", lost)
    with pytest.raises(RuntimeError):
        inv.Ledger.load(spark, path).add_all(df).save(path)
    monkeypatch.undo()
    back = inv.Ledger.load(spark, path)
    assert back.current().count() == 2 and back.next_batch == 2
    assert back.add_all(df).save(path).current().count() == 4


def test_totals_of_a_stored_ledger_read_no_rows(spark, scratch):
    df = cleaned(spark, [stone(price=p) for p in (100, 200, 400)])
    path = os.path.join(scratch, "totals")
    led = inv.Ledger(spark).add_all(df).clear().add_all(df).add_manual(1.0, "Ideal", "D", "IF", 701).save(path)
    t = inv.Ledger.load(spark, path).totals()
    assert tuple(t.first()) == (4, 1401, 350.25)
    assert "Scan parquet" not in t._jdf.queryExecution().executedPlan().toString()
    assert tuple(led.add_all(df).totals().first()) == (7, 2101, 300.142857)
    assert tuple(led.clear().totals().first()) == (0, None, None)
    assert tuple(inv.Ledger(spark).totals().first()) == (0, None, None)


def test_numbers_follow_batches_files_and_picks(spark):
    rows = [(i / 10, "Ideal", "E", "IF", 1000 - i, i * 7 % 50) for i in range(50)]
    df = spark.createDataFrame(rows, f"carat double, cut string, color string, clarity string, price bigint, {ORDINAL} bigint").repartition(5)
    listed = flt.listing(df, 20)
    got = inv.Ledger(spark).add_selected(listed, [7, 2, 5]).add_all(df).add_all(df).numbered().orderBy("no").collect()
    in_file = [r[4] for r in sorted(rows, key=lambda r: r[5])]
    assert [r.no for r in got] == list(range(103))
    assert [r.price for r in got] == [in_file[6], in_file[1], in_file[4], *in_file, *in_file]
    assert set(got[0].asDict()) == {"no", *inv.Ledger(spark).items}


def test_numbering_splits_many_equal_rows_and_plans_no_single_task(spark):
    df = spark.createDataFrame([(1,)] * 400 + [(i,) for i in range(100)], "v int").repartition(7)
    got = numbering.numbered(df, [F.col("v")])
    assert [r.v for r in got.orderBy("no").collect()] == sorted([1] * 400 + list(range(100)))
    assert sorted(r.no for r in got.collect()) == list(range(500))
    sizes = [r["count"] for r in numbering.ranged(df, [F.col("v")]).groupBy("_range").count().collect()]
    assert max(sizes) < 200
