import os
import uuid

from gemstats.analytics import DiamondAnalytics
from gemstats.operators.insight import ANALYSIS_TYPES
from gemstats.sources.fixture import diamond_raw
from tests.conftest import SF_SMALL


def test_pages_over_a_csv_upload(spark, scratch):
    path = os.path.join(scratch, "upload_csv")
    diamond_raw(spark, SF_SMALL).coalesce(2).write.option("header", True).csv(path)
    a = DiamondAnalytics.load(spark, path, fmt="csv")
    assert a.quality_report().first().rows == 5964
    assert a.preview().count() == 5
    ov = a.overview()
    assert ov["metrics"].first().total_diamonds == 5964
    for t in ANALYSIS_TYPES:
        page = a.analysis(t)
        for name, df in page.items():
            assert df.count() >= 0, (t, name)
    sel = a.filtered(price=(1000, 5000), colors=["D", "E"])
    n = sel.count()
    c = a.filter_counts(price=(1000, 5000), colors=["D", "E"]).first()
    assert c.n_filtered == n <= c.n_total
    led = a.ledger().add_selected(a.listing(price=(1000, 5000)), [1, 2]).add_all(sel)
    assert led.totals().first().items == n + 2


def test_same_numbers_as_registered_queries(spark):
    import __spark_entry__ as entry
    a = DiamondAnalytics.from_frame(spark, diamond_raw(spark, SF_SMALL), f"fixture|{SF_SMALL}")
    mine = sorted(tuple(r) for r in a.analysis("Color Analysis")["price_per_carat"].collect())
    reg = sorted(tuple(r) for r in entry.queries()["color_profile"](spark, SF_SMALL).collect())
    assert mine == reg


HEADER = "carat,cut,color,clarity,price\n"


def write_csv_file(path, *rows):
    with open(path, "w") as fh:
        fh.write(HEADER + "".join(",".join(map(str, r)) + "\n" for r in rows))


def test_overwritten_upload_is_cleaned_again(spark, scratch):
    path = os.path.join(scratch, "d.csv")
    write_csv_file(path, (1.0, "Good", "E", "SI1", 400), (1.1, "Good", "E", "SI1", 500), (1.2, "Good", "E", "SI1", 600))
    first = DiamondAnalytics.load(spark, path)
    assert first.df.count() == 3
    write_csv_file(path, (2.0, "Ideal", "D", "IF", 900))
    assert DiamondAnalytics.load(spark, path).df.count() == 1
    assert first.df.count() == 3  # the version before stays for those who read it


def test_second_frame_under_one_key_is_another_table(spark):
    schema = "carat double, cut string, color string, clarity string, price bigint"
    a = spark.createDataFrame([(1.0, "Good", "E", "SI1", 400)], schema)
    b = spark.createDataFrame([(1.0, "Good", "E", "SI1", 400), (2.0, "Good", "E", "SI1", 700)], schema)
    assert DiamondAnalytics.from_frame(spark, a, "k").df.count() == 1
    assert DiamondAnalytics.from_frame(spark, b, "k").df.count() == 2
    assert DiamondAnalytics.from_frame(spark, a, "k").df.count() == 1


def test_another_session_reuses_the_stored_table(spark):
    from gemstats.plans import store
    from gemstats.sources.fixture import diamond_raw as raw
    built, name = [], f"reuse-{uuid.uuid4().hex}"  # the folder may be shared with other runs

    def build():
        built.append(1)
        return raw(spark, SF_SMALL)

    identity = store.files_identity(spark, f"{SF_SMALL}/lineitem.parquet")
    first = store.stored(spark, name, identity, build)
    store._RESOLVED.clear()  # as a new session starts
    again = store.stored(spark, name, identity, build)
    assert built == [1] and first.inputFiles() == again.inputFiles()
    for _ in range(3):
        newest = store.stored(spark, name, identity, build, refresh=True)
    folder = os.path.dirname(os.path.dirname(newest.inputFiles()[0].removeprefix("file:").replace("//", "/")))
    assert len(os.listdir(folder)) == 2


def test_ledger_of_a_table_has_its_columns(spark):
    df = spark.createDataFrame([(1.0, "Good", "E", "SI1", 400.5, 61.0)], "carat double, cut string, color string, clarity string, price double, depth double")
    led = DiamondAnalytics.from_frame(spark, df, "wide").ledger()
    assert {"depth", "price"} <= set(led.items) and led.schema["price"].dataType.simpleString() == "double"
