"""Range and membership filters, their bounds and options, and the listing.

Predicates are plain column expressions: on a Parquet table Catalyst
pushes the ranges and IN lists into the scan (``PushedFilters``), and an
empty member list folds to an empty relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grades
from ..functions.text import item_label
from ..sources.order import ORDINAL
from .clean import natural_order

LISTING_COLUMNS = ["carat", "cut", "color", "clarity", "price"]


def in_range(column: str, bounds: tuple | None) -> Column:
    """``lo <= column <= hi``; either end may be None (open); None = no predicate."""
    if bounds is None:
        return F.lit(True)
    lo, hi = bounds
    col = F.col(column)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (col >= F.lit(lo))
    if hi is not None:
        cond = cond & (col <= F.lit(hi))
    return cond


def member_of(column: str, values: list | None) -> Column:
    """``column IN values``; None = no predicate, an empty list keeps nothing."""
    if values is None:
        return F.lit(True)
    if len(values) == 0:
        return F.lit(False)
    return F.col(column).isin(list(values))


def diamond_predicate(price: tuple | None = None, carat: tuple | None = None,
                      colors: list | None = None, clarities: list | None = None,
                      cuts: list | None = None) -> Column:
    return (in_range("price", price) & in_range("carat", carat)
            & member_of("color", colors) & member_of("clarity", clarities)
            & member_of("cut", cuts))


def apply_filters(df: DataFrame, **kw) -> DataFrame:
    return df.filter(diamond_predicate(**kw))


def filter_bounds(df: DataFrame) -> DataFrame:
    """Slider ends: whole-dollar price bounds (truncated), carat min / max."""
    return df.agg(F.floor(F.min("price")).cast("bigint").alias("price_min"),
                  F.floor(F.max("price")).cast("bigint").alias("price_max"),
                  F.min("carat").cast("double").alias("carat_min"),
                  F.max("carat").cast("double").alias("carat_max"))


def filter_options(df: DataFrame, dims: tuple[str, ...] = ("color", "clarity", "cut")) -> DataFrame:
    """``dimension, value`` for every distinct non-NULL value of each grade
    column: one pass and one (partially aggregated) shuffle of grade combinations
    for all three, with ``place``, the value's place in its list (from 1).
    Colors sort by name (D first). Clarity and cut come in the order in which
    the file first has them, if the rows have an ordinal; else best grade first,
    as the entry form lists them."""
    # the few grade combinations first, so only they are exploded
    seen = F.min(ORDINAL) if ORDINAL in df.columns else F.lit(0)
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                                for d in dims])).alias("p")
    opts = (df.groupBy(*dims).agg(seen.alias("_seen")).select(pairs, "_seen").select("p.*", "_seen")
              .filter(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.min("_seen").alias("_seen")))
    rank = (F.when(F.col("dimension") == "clarity", grades.rank_of(grades.CLARITY_CHOICES, "value"))
             .when(F.col("dimension") == "cut", grades.rank_of(grades.CUT_CHOICES, "value")))
    order = [F.when(F.col("dimension") != "color", F.col("_seen")).asc(), rank.asc_nulls_last(), F.col("value")]
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(*order))  # a few grades
    return opts.select("dimension", "value", place.alias("place")).orderBy("dimension", "place")


def filter_counts(df: DataFrame, predicate: Column) -> DataFrame:
    """"n of N": matching and total rows in one pass."""
    return df.agg(F.count_if(predicate).alias("n_filtered"), F.count(F.lit(1)).alias("n_total"))


def listing(df: DataFrame, n: int = grades.LISTING_ROWS) -> DataFrame:
    """The first ``n`` rows in the file's order (the natural order, if they have
    no ordinal), numbered ``pos`` 1..n.

    ``limit`` after ``orderBy`` plans as a top-k (each task keeps its own
    best ``n``), so the numbering window sees at most ``n`` rows."""
    order = natural_order(df)
    top = df.orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("pos"), *df.columns).drop(ORDINAL)


def available(df: DataFrame, n: int = grades.LISTING_ROWS) -> DataFrame:
    """The five listing columns of the first ``n`` rows."""
    return listing(df, n).select("pos", *LISTING_COLUMNS)


def item_labels(df: DataFrame, n: int = grades.LISTING_ROWS) -> DataFrame:
    return listing(df, n).select("pos", item_label("pos", price_type=df.schema["price"].dataType).alias("label"))

