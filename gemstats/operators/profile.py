"""Numeric profile of a measure, and the overview metrics.

Moments, extremes, shares and the correlation are one aggregate pass;
the exact quartiles come from the distributed cumulative counts and are
attached as one (merged) scalar subquery, so no join of one-row frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grades
from ..functions.stats import r6, safe_corr, share_pct
from ..functions.text import dollars, fixed, grouped, thousands
from .ranks import quantiles

QUARTILES = [0.25, 0.5, 0.75]


def overview_metrics(df: DataFrame, measure: str = "price", size: str = "carat") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_diamonds"),
                  r6(F.avg(measure)).alias(f"avg_{measure}"),
                  r6(F.avg(size)).alias(f"avg_{size}"),
                  F.min(measure).alias(f"min_{measure}"),
                  F.max(measure).alias(f"max_{measure}"))


def overview_labels(df: DataFrame) -> DataFrame:
    """KPI texts: ``{n:,}``, ``${mean:,.0f}``, ``{mean:.2f}``, ``${min:,} - ${max:,}``."""
    kind = df.schema["price"].dataType  # cents stay in the range
    one = df.agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("ap"), F.avg("carat").alias("ac"),
                 F.min("price").alias("lo"), F.max("price").alias("hi"))
    return one.select(
        thousands("n").alias("total_label"),
        dollars("ap").alias("avg_price_label"),
        fixed("ac", 2).alias("avg_carat_label"),
        F.concat(F.lit("$"), grouped("lo", kind), F.lit(" - $"), grouped("hi", kind)).alias("price_range_label"))


def numeric_profile(df: DataFrame, value: str = "carat", partner: str = "price",
                    small_max: float = grades.SMALL_CARAT_MAX,
                    large_min: float = grades.LARGE_CARAT_MIN, method: str = "linear") -> DataFrame:
    """Mean, median, sample std, range, quartiles, two shares and r(partner, value).
    Quartiles are exact type 7 by default; ``method="approx"`` uses a sketch."""
    q = quantiles(df, value, QUARTILES, ["q25", "q50", "q75"], method=method)
    qs = q.select(F.struct("q25", "q50", "q75")).scalar()
    v = F.col(value)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg(v)).alias(f"avg_{value}"),
        r6(F.stddev_samp(v)).alias(f"{value}_std"),
        F.min(v).alias(f"min_{value}"),
        F.max(v).alias(f"max_{value}"),
        r6(share_pct(v <= small_max)).alias("small_pct"),
        r6(share_pct(v >= large_min)).alias("large_pct"),
        r6(safe_corr(partner, value)).alias(f"{partner}_{value}_corr"),
    ).select("*",
             r6(qs.getField("q50")).alias(f"median_{value}"),
             r6(qs.getField("q25")).alias("q25"),
             r6(qs.getField("q50")).alias("q50"),
             r6(qs.getField("q75")).alias("q75"))


def carat_stats(df: DataFrame, method: str = "linear") -> DataFrame:
    p = numeric_profile(df, "carat", "price", method=method)
    return p.select("avg_carat", "median_carat", "carat_std", "min_carat", "max_carat",
                    "q25", "q50", "q75", "price_carat_corr")


def carat_shares(df: DataFrame) -> DataFrame:
    v = F.col("carat")
    return df.agg(r6(share_pct(v <= grades.SMALL_CARAT_MAX)).alias("small_diamonds_pct"),
                  r6(share_pct(v >= grades.LARGE_CARAT_MIN)).alias("large_diamonds_pct"))
