"""Pearson correlation matrix with pairwise deletion, as a long table.

All k*(k-1)/2 pairs and k diagonals are computed in one aggregate (one
pass, partial aggregation), then mirrored into ``(var_x, var_y, r)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grades
from ..functions.stats import r6, safe_corr, self_corr

CORR_COLUMNS = ("price", "carat", "color_numeric", "clarity_numeric")


def corr_pairs(df: DataFrame, columns: tuple[str, ...] = CORR_COLUMNS) -> tuple[DataFrame, dict]:
    """One row with ``r_<a>__<b>`` for each unordered pair (diagonal included),
    and the column name of every ordered pair."""
    aggs, seen = [], {}
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            if j < i:
                continue
            name = f"r_{a}__{b}"
            aggs.append((self_corr(a) if i == j else safe_corr(a, b)).alias(name))
            seen[(a, b)] = seen[(b, a)] = name
    return df.agg(*aggs), seen


def corr_matrix(df: DataFrame, columns: tuple[str, ...] = CORR_COLUMNS) -> DataFrame:
    """Long form ``var_x, var_y, r``; empty when a column is absent."""
    if not all(c in df.columns for c in columns):
        return df.select(F.lit("").alias("var_x"), F.lit("").alias("var_y"), F.lit(0.0).alias("r")).where(F.lit(False))
    wide, names = corr_pairs(df, columns)
    cells = [F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
                      r6(F.col(names[(a, b)])).alias("r"))
             for a in columns for b in columns]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def corr_flags(df: DataFrame) -> DataFrame:
    """Price correlations with carat, color and clarity, and the two flags."""
    one = df.agg(safe_corr("price", "carat").alias("pc"),
                 safe_corr("price", "color_numeric").alias("pcol"),
                 safe_corr("price", "clarity_numeric").alias("pcl"))
    return one.select(
        r6(F.col("pc")).alias("price_carat_corr"),
        r6(F.col("pcol")).alias("price_color_corr"),
        r6(F.col("pcl")).alias("price_clarity_corr"),
        F.coalesce(F.abs("pc") > grades.STRONG_CORRELATION, F.lit(False)).alias("carat_dominates_pricing"),
        F.coalesce(F.abs("pcol") < grades.WEAK_CORRELATION, F.lit(False)).alias("color_weak_correlation"))


# The text lines of the correlation summary and the label each
# line carries whatever the value is.
CORR_LINES = [
    ("carat", "Carat vs Price correlation", "Very Strong"),
    ("color_numeric", "Color vs Price correlation", "Weak"),
    ("clarity_numeric", "Clarity vs Price correlation", "Moderate"),
]


def corr_labels(df: DataFrame) -> DataFrame:
    """``<name>: <r:.3f> (<label>)`` lines; ``strength`` grades |r| honestly
    (>= 0.8 Very Strong, >= 0.3 Moderate, else Weak)."""
    one = df.agg(*[safe_corr("price", col).alias(col) for col, _, _ in CORR_LINES])
    rows = []
    for col, title, label in CORR_LINES:
        r = F.col(col)
        strength = (F.when(F.abs(r) >= grades.STRONG_CORRELATION, "Very Strong")
                     .when(F.abs(r) >= grades.WEAK_CORRELATION, "Moderate")
                     .when(r.isNotNull(), "Weak"))
        text = F.concat(F.lit(f"{title}: "),
                        F.coalesce(F.regexp_replace(F.format_number(r, 3), ",", ""), F.lit("nan")),
                        F.lit(f" ({label})"))
        rows.append(F.struct(F.lit(col).alias("variable"), text.alias("line"),
                             F.lit(label).alias("label"), strength.alias("strength")))
    return one.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
