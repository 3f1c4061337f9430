"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables in ``sf_dir`` (through the synthetic
diamond view) and runs over all of their rows. Cleaning-step queries
build from the raw view; every other query reads the cleaned table,
written once per session to the shared folder (``plans.store``).

The filter and inventory parameters below are one fixed user session:
slider and selection values, not row caps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grades
from ..operators import category as cat
from ..operators import clean as cln
from ..operators import correlation as cor
from ..operators import distribution as dst
from ..operators import filters as flt
from ..operators import insight as ins
from ..operators import inventory as inv
from ..operators import profile as prf
from ..operators import sketches as skt
from ..operators.cube import FilterCube
from ..operators.ranks import exact_quantiles
from ..session import shared_dir
from ..sources.files import parse_columns, read_table, write_csv
from ..functions.stats import r6
from ..sources.order import ORDINAL
from ..sources.fixture import diamond_raw, diamond_raw_from, diamond_with_text_carat, table
from .store import cleaned_diamonds, files_identity

# One fixed filter session (slider / multiselect values).
PRICE_RANGE = (1000, 5000)
CARAT_RANGE = (0.5, 2.0)
COLORS = ["D", "E", "F", "G"]
CLARITIES = ["VS1", "VS2", "VVS1", "VVS2", "IF"]
CUTS = ["Ideal", "Premium", "Very Good"]
PICKED = [1, 2, 5, 10, 50, 100]           # listing positions picked by hand
MANUAL = (1.5, "Ideal", "E", "VS1", 12000)  # one hand-entered stone

Query = Callable[[SparkSession, str], DataFrame]


def _ordered(spark, sf):
    """The cleaned table with the rows' ordinals in the source file."""
    return cleaned_diamonds(spark, sf)


def _clean(spark, sf):
    return cleaned_diamonds(spark, sf).drop(ORDINAL)


def _steps(spark, sf, upto: str) -> DataFrame:
    df = diamond_raw(spark, sf).transform(cln.drop_index_column).transform(cln.drop_duplicate_rows)
    if upto == "dedup":
        return df
    df = df.transform(cln.drop_missing)
    if upto == "missing":
        return df
    df = df.transform(cln.drop_invalid_dimensions)
    if upto == "dims":
        return df
    return df.transform(cln.add_grade_ordinals)


def _mapped(spark, sf) -> DataFrame:
    """The grade mapping applied afresh to the stored table's input columns
    (the de-duplication is not run again for it)."""
    return _clean(spark, sf).drop(*cln.DERIVED).transform(cln.add_grade_ordinals)


def _all_filters(df):
    return flt.apply_filters(df, price=PRICE_RANGE, carat=CARAT_RANGE, colors=COLORS,
                             clarities=CLARITIES, cuts=CUTS)


def _session_ledger(spark, sf) -> inv.Ledger:
    """add all price-filtered -> pick from listing -> manual -> clear ->
    add all fully filtered -> pick three -> manual."""
    c = _ordered(spark, sf)
    listed = flt.listing(_all_filters(_ordered(spark, sf)))
    led = (inv.Ledger(spark)
           .add_all(flt.apply_filters(c, price=PRICE_RANGE))
           .add_selected(listed, PICKED)
           .add_manual(*MANUAL)
           .clear()
           .add_all(_all_filters(c))
           .add_selected(listed, [1, 2, 3])
           .add_manual(*MANUAL))
    return led


def _current(led: inv.Ledger) -> DataFrame:
    return led.current().drop("row_id", "seq")


def _stored(led: inv.Ledger, batches: int) -> inv.Ledger:
    """The session's ledger saved in two goes, the second after another session
    has saved and cleared, and loaded again."""
    path = f"{shared_dir(led.spark).rstrip('/')}/gemstats/ledger-{uuid.uuid4().hex}"
    first = inv.Ledger(led.spark, (), led.batches[:batches], led.item_schema).save(path)
    first.add_manual(*MANUAL).clear().save(path)
    inv.Ledger(led.spark, first.commits, led.batches[batches:], led.item_schema, path).save(path)
    return inv.Ledger.load(led.spark, path)


def _spiked(df: DataFrame) -> DataFrame:
    """The cleaned table with one price in 97 far above its group."""
    return df.withColumn("price", F.when(F.col("price") % 97 == 0, F.col("price") * 20).otherwise(F.col("price")))


def _cents(df: DataFrame) -> DataFrame:
    """The cleaned table with prices in dollars and cents."""
    return df.withColumn("price", F.col("price") + (F.col("price") % 4) / F.lit(4.0))


def _partly_priced(df: DataFrame) -> DataFrame:
    """A view in which one cut, one color and one clarity have no price at all."""
    gone = (F.col("cut") == "Fair") | (F.col("color") == "D") | (F.col("clarity") == "IF")
    return df.withColumn("price", F.when(~gone, F.col("price")))


def _wide(df: DataFrame) -> DataFrame:
    """Two columns beyond the preset ones."""
    return df.withColumn("depth", F.floor(F.col("z") / (F.col("x") + F.col("y")) * 20000) / 100).withColumn("lab", F.concat(F.lit("lab "), F.col("cut")))


def _out_of_range(df: DataFrame) -> DataFrame:
    """Every fifth price too low or too high, every third carat too large or missing."""
    price = F.when(F.col("price") % 10 == 0, F.col("price") % 100).when(F.col("price") % 10 == 5, F.col("price") * 1000).otherwise(F.col("price"))
    carat = F.when(F.col("price") % 3 == 0, F.when(F.col("price") % 2 == 0, F.col("carat") * 100)).otherwise(F.col("carat"))
    return df.withColumns({"price": price, "carat": carat})


def _zero_dims(df: DataFrame) -> DataFrame:
    """Raw listings with zeros in every dimension."""
    return df.withColumns({"y": F.when(F.col("price") % 11 == 0, 0.0).otherwise(F.col("y")),
                           "z": F.when(F.col("price") % 13 == 0, 0.0).otherwise(F.col("z"))})


def _offset(df: DataFrame) -> DataFrame:
    """Carats in sixteenths around 10^8 and prices around 10^9: figures that raw
    sums of squares can't hold."""
    return df.withColumns({"carat": F.floor(F.col("carat") * 16) / F.lit(16.0) + F.lit(1e8), "price": F.col("price") + F.lit(10**9)})


def _csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Raw listings written as CSV with a saved index, read again and cleaned."""
    path = f"{shared_dir(spark).rstrip('/')}/gemstats/csv-{uuid.uuid4().hex}"
    raw = diamond_raw(spark, sf).withColumn("color", F.when(F.col("color") == "K", "1D").otherwise(F.col("color")))
    write_csv(raw.select(F.monotonically_increasing_id().alias("Unnamed: 0"), "*"), path)
    return cln.clean(read_table(spark, path, "csv"))


def _line_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Raw listings whose cuts hold line breaks, quotes and commas, written as CSV
    and read again in the file's order, with the records' numbers."""
    path = f"{shared_dir(spark).rstrip('/')}/gemstats/csv-{uuid.uuid4().hex}"
    cut = F.when(F.col("price") % 3 == 0, F.concat(F.lit('"'), F.col("cut"), F.lit('",\n\n'), F.col("color"))).otherwise(F.col("cut"))
    rows = diamond_raw_from(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")
    write_csv(rows.orderBy("l_orderkey", "l_linenumber", "carat", "price", "cut", "color", "x").withColumn("cut", cut), path)
    return read_table(spark, path, "csv", ordered=True).withColumnRenamed(ORDINAL, "record")


def _row_identity(spark: SparkSession, sf: str) -> DataFrame:
    """How many stones the narrow selection has, how many keys, and how many
    stones those keys pick out of a listing with other filters."""
    cur = inv.Ledger(spark).add_all(_wide(_all_filters(_clean(spark, sf)))).current()
    other = _wide(flt.apply_filters(_clean(spark, sf), price=PRICE_RANGE))
    again = inv.Ledger(spark).add_keys(other, cur.select("row_id")).current()

    def one(what: str, df: DataFrame, agg) -> DataFrame:
        return df.agg(agg.alias("n")).select(F.lit(what).alias("what"), "n")

    return (one("items", cur, F.count(F.lit(1))).union(one("keys", cur, F.count_distinct("row_id")))
            .union(one("picked again", again, F.count(F.lit(1)))))


def _saved_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt rows stored as JSON and read again, their bundles in long form."""
    path = f"{shared_dir(spark).rstrip('/')}/gemstats/insights-{uuid.uuid4().hex}"
    ins.save_insights(ins.insight_prompts(ins.all_insight_stats(_clean(spark, sf))), path)
    return ins.insight_fields(spark.read.json(path))


def _exported(spark: SparkSession, sf: str) -> DataFrame:
    """The session's inventory exported as CSV and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/gemstats/csv-{uuid.uuid4().hex}"
    inv.export_csv(_session_ledger(spark, sf).current(), path)
    return read_table(spark, path, "csv")


def _quartiles(df: DataFrame, value: str) -> DataFrame:
    q = exact_quantiles(df, value, [0.05, 0.25, 0.5, 0.75, 0.999])
    return q.select(*[r6(F.col(c)).alias(c) for c in q.columns])


_CUBES: dict[tuple[str, str], FilterCube] = {}  # built once an application and table


def _cube(spark: SparkSession, sf: str) -> FilterCube:
    key = (spark.sparkContext.applicationId, files_identity(spark, f"{sf.rstrip('/')}/lineitem.parquet"))
    if key not in _CUBES:
        _CUBES[key] = FilterCube.build(_clean(spark, sf), f"{shared_dir(spark).rstrip('/')}/gemstats/cube-{uuid.uuid4().hex}")
    return _CUBES[key]


def _sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Price quantiles a clarity from the stored sketches of four parts: whether
    the exact ranks confirm the stated error."""
    path = f"{shared_dir(spark).rstrip('/')}/gemstats/sketches-{uuid.uuid4().hex}"
    rows = _clean(spark, sf)
    for i in range(4):
        skt.add_part(rows.filter(F.col("price") % 4 == i), "price", ["clarity"], path)
    found = skt.merged_quantiles(spark.read.parquet(path), [0.05, 0.25, 0.5, 0.75, 0.95], ["clarity"])
    return skt.rank_check(rows, "price", found, ["clarity"]).select("clarity", "p", "n", (F.col("off") <= skt.rank_error()).alias("within"))


def _na_tokens(spark, sf):
    return parse_columns(diamond_with_text_carat(spark, sf), {"carat": T.DoubleType()})


QUERIES: dict[str, Query] = {
    # -- sources / cleaning -------------------------------------------------
    "na_tokens": _na_tokens,
    "csv_round_trip": _csv_round_trip,
    "csv_line_breaks": _line_breaks,
    "inv_export": _exported,
    "clean_whole": lambda s, sf: cln.clean(diamond_raw(s, sf)),
    "valid_dims_all": lambda s, sf: cln.drop_invalid_dimensions(_zero_dims(diamond_raw(s, sf))),
    "dedup_rows": lambda s, sf: _steps(s, sf, "dedup"),
    "drop_missing": lambda s, sf: _steps(s, sf, "missing"),
    "valid_dims": lambda s, sf: _steps(s, sf, "dims"),
    "color_ordinal": lambda s, sf: _mapped(s, sf).groupBy("color", "color_numeric").agg(
        F.count(F.lit(1)).alias("n")),
    "clarity_ordinal": lambda s, sf: _mapped(s, sf).groupBy("clarity", "clarity_numeric").agg(
        F.count(F.lit(1)).alias("n")),
    "cut_lab_grade": lambda s, sf: _mapped(s, sf).groupBy("cut", "cut_gia").agg(
        F.count(F.lit(1)).alias("n")),
    "unmapped_grades": lambda s, sf: _mapped(s, sf).filter(
        F.col("color_numeric").isNull() | F.col("clarity_numeric").isNull() | F.col("cut_gia").isNull()),
    "clean_rows": lambda s, sf: _clean(s, sf),
    "quality_report": lambda s, sf: cln.quality_report(_clean(s, sf)),
    "preview": lambda s, sf: cln.preview(_ordered(s, sf)),
    # -- filters and listing --------------------------------------------------
    "filter_price": lambda s, sf: flt.apply_filters(_clean(s, sf), price=PRICE_RANGE),
    "filter_carat": lambda s, sf: flt.apply_filters(_clean(s, sf), carat=CARAT_RANGE),
    "filter_members": lambda s, sf: flt.apply_filters(_clean(s, sf), colors=COLORS,
                                                      clarities=CLARITIES, cuts=CUTS),
    "filter_all": lambda s, sf: _all_filters(_clean(s, sf)),
    "filter_bounds": lambda s, sf: flt.filter_bounds(_clean(s, sf)),
    "filter_options": lambda s, sf: flt.filter_options(_ordered(s, sf)),
    "filter_counts": lambda s, sf: flt.filter_counts(
        _clean(s, sf), flt.diamond_predicate(price=PRICE_RANGE, carat=CARAT_RANGE, colors=COLORS,
                                             clarities=CLARITIES, cuts=CUTS)),
    "filter_counts_cube": lambda s, sf: _cube(s, sf).counts(price=PRICE_RANGE, carat=CARAT_RANGE, colors=COLORS,
                                                            clarities=CLARITIES, cuts=CUTS),
    "available_top100": lambda s, sf: flt.available(_all_filters(_ordered(s, sf))),
    "item_label": lambda s, sf: flt.item_labels(_all_filters(_ordered(s, sf))),
    # -- numeric profile -----------------------------------------------------
    "overview_metrics": lambda s, sf: prf.overview_metrics(_clean(s, sf)),
    "overview_labels": lambda s, sf: prf.overview_labels(_clean(s, sf)),
    "overview_labels_cents": lambda s, sf: prf.overview_labels(_cents(_clean(s, sf))),
    "item_label_cents": lambda s, sf: flt.item_labels(_cents(_all_filters(_ordered(s, sf)))),
    "carat_stats": lambda s, sf: prf.carat_stats(_clean(s, sf)),
    "carat_shares": lambda s, sf: prf.carat_shares(_clean(s, sf)),
    # -- category profiles -----------------------------------------------------
    "cut_counts": lambda s, sf: cat.frequency(_clean(s, sf), "cut"),
    "cut_extremes": lambda s, sf: cat.cut_extremes(_clean(s, sf)),
    "cut_avg_price": lambda s, sf: cat.mean_by(_clean(s, sf), "cut", "price"),
    "cut_premium_share": lambda s, sf: cat.grade_shares(
        _clean(s, sf), "cut", {"premium_cuts_pct": grades.PREMIUM_CUTS}),
    "color_counts": lambda s, sf: cat.frequency(_clean(s, sf), "color", by_key=True),
    "color_profile": lambda s, sf: cat.color_profile(_clean(s, sf)),
    "color_extremes": lambda s, sf: cat.color_extremes(_clean(s, sf)),
    "color_premium_share": lambda s, sf: cat.grade_shares(
        _clean(s, sf), "color", {"premium_colors_pct": grades.PREMIUM_COLORS}),
    "cut_extremes_partly_priced": lambda s, sf: cat.cut_extremes(_partly_priced(_clean(s, sf))),
    "color_extremes_partly_priced": lambda s, sf: cat.color_extremes(_partly_priced(_clean(s, sf))),
    "clarity_extremes_partly_priced": lambda s, sf: cat.clarity_extremes(_partly_priced(_clean(s, sf))),
    "price_paradoxes": lambda s, sf: cat.price_paradoxes(_clean(s, sf)),
    "clarity_counts": lambda s, sf: cat.frequency(_clean(s, sf), "clarity"),
    "clarity_extremes": lambda s, sf: cat.clarity_extremes(_clean(s, sf)),
    "clarity_shares": lambda s, sf: cat.grade_shares(
        _clean(s, sf), "clarity", {"sweet_spot_clarity_pct": grades.SWEET_SPOT_CLARITIES,
                                   "premium_clarity_pct": grades.PREMIUM_CLARITIES}),
    "clarity_avg_price": lambda s, sf: cat.mean_by(_clean(s, sf), "clarity", "price"),
    # -- distributions ---------------------------------------------------------
    "hist_carat": lambda s, sf: dst.histogram(_clean(s, sf), "carat", grades.CARAT_BINS),
    "hist_price": lambda s, sf: dst.histogram(_clean(s, sf), "price", grades.PRICE_BINS),
    "ecdf_rows": lambda s, sf: dst.ecdf_rows(_clean(s, sf), "carat"),
    "ecdf_values": lambda s, sf: dst.ecdf_values(_clean(s, sf), "carat"),
    "ecdf_thresholds": lambda s, sf: dst.ecdf_thresholds(_clean(s, sf), "carat"),
    "box_price_by_clarity": lambda s, sf: dst.box_stats(_clean(s, sf), "price", "clarity"),
    "box_outliers": lambda s, sf: dst.box_outliers(_clean(s, sf), "price", "clarity"),
    "scatter_density": lambda s, sf: dst.scatter_density(_clean(s, sf)),
    "scatter_points": lambda s, sf: dst.scatter_points(_clean(s, sf)),
    # a measure with many distinct values and with real outliers
    "ecdf_price_values": lambda s, sf: dst.ecdf_values(_clean(s, sf), "price"),
    "ecdf_retail_values": lambda s, sf: dst.ecdf_values(table(s, sf, "part"), "p_retailprice"),
    "price_quartiles": lambda s, sf: _quartiles(_clean(s, sf), "price"),
    "sketch_quantiles": _sketched,
    "retail_quartiles": lambda s, sf: _quartiles(table(s, sf, "part"), "p_retailprice"),
    "box_spiked_by_clarity": lambda s, sf: dst.box_stats(_spiked(_clean(s, sf)), "price", "clarity"),
    "box_outliers_spiked": lambda s, sf: dst.box_outliers(_spiked(_clean(s, sf)), "price", "clarity"),
    # -- correlation -----------------------------------------------------------
    "corr_matrix": lambda s, sf: cor.corr_matrix(_clean(s, sf)),
    "corr_skipped": lambda s, sf: cor.corr_matrix(_clean(s, sf).drop("color_numeric")),
    "corr_flags": lambda s, sf: cor.corr_flags(_clean(s, sf)),
    "corr_labels": lambda s, sf: cor.corr_labels(_clean(s, sf)),
    # -- insight dataset -------------------------------------------------------
    "insight_stats": lambda s, sf: ins.all_insight_stats(_clean(s, sf)),
    "insight_prompts": lambda s, sf: ins.insight_prompts(ins.all_insight_stats(_clean(s, sf))),
    "insight_fields": lambda s, sf: ins.insight_fields(ins.all_insight_stats(_clean(s, sf))),
    "insight_fields_offset": lambda s, sf: ins.insight_fields(ins.all_insight_stats(_offset(_clean(s, sf)))),
    "corr_matrix_offset": lambda s, sf: cor.corr_matrix(_offset(_clean(s, sf))),
    "insight_saved_fields": _saved_fields,
    "insight_prompt_checks": lambda s, sf: ins.prompt_checks(ins.insight_prompts(ins.all_insight_stats(_clean(s, sf)))),
    # -- inventory ledger --------------------------------------------------------
    "inv_add_selected": lambda s, sf: _current(
        inv.Ledger(s).add_selected(flt.listing(_all_filters(_ordered(s, sf))), PICKED)),
    "inv_add_filtered": lambda s, sf: _current(inv.Ledger(s).add_all(_all_filters(_clean(s, sf)))),
    "inv_add_manual": lambda s, sf: _current(
        inv.Ledger(s).add_all(flt.apply_filters(_clean(s, sf), price=PRICE_RANGE)).add_manual(*MANUAL)),
    "inv_validate": lambda s, sf: inv.validate_manual(diamond_raw(s, sf)),
    "inv_validate_ranges": lambda s, sf: inv.validate_manual(_out_of_range(diamond_raw(s, sf))),
    "inv_wide": lambda s, sf: _current(inv.Ledger(s).add_all(_wide(_all_filters(_clean(s, sf)))).add_manual(*MANUAL)),
    "inv_row_identity": _row_identity,
    "inv_fractional": lambda s, sf: _current(
        inv.Ledger(s).add_all(_cents(_all_filters(_clean(s, sf)))).add_manual(*MANUAL[:4], 12000.5)),
    "inv_fractional_totals": lambda s, sf:
        inv.Ledger(s).add_all(_cents(_all_filters(_clean(s, sf)))).add_manual(*MANUAL[:4], 12000.5).totals(),
    "inv_bag": lambda s, sf: _current(
        inv.Ledger(s).add_all(flt.apply_filters(_clean(s, sf), colors=COLORS, clarities=CLARITIES, cuts=CUTS))
                     .add_all(flt.apply_filters(_clean(s, sf), colors=COLORS, clarities=CLARITIES, cuts=CUTS))),
    "inv_totals": lambda s, sf: _session_ledger(s, sf).totals(),
    "inv_current": lambda s, sf: _current(_session_ledger(s, sf)),
    "inv_numbered": lambda s, sf: _session_ledger(s, sf).numbered(),
    "inv_stored_totals": lambda s, sf: _stored(_session_ledger(s, sf), 4).totals(),
    "inv_stored_numbered": lambda s, sf: _stored(_session_ledger(s, sf), 4).numbered(),
    # -- the same generic operators on a second table (part) --------------------
    "part_brand_profile": lambda s, sf: cat.category_profile(table(s, sf, "part"), "p_brand", ("p_retailprice",))
        .select("p_brand", "n", r6(F.col("avg_p_retailprice")).alias("avg_p_retailprice")),
    "part_price_hist": lambda s, sf: dst.histogram(table(s, sf, "part"), "p_retailprice", 30),
    "part_price_box_by_type": lambda s, sf: dst.box_stats(table(s, sf, "part"), "p_retailprice", "p_type"),
}
