"""Category profiles: frequency, mean measures, extremes and shares.

One ``groupBy`` per category column (partial aggregation before the
shuffle, so a hot category costs one row per map task); everything else
is derived from its few result rows. NULL keys are left out of the
groups, while shares divide by all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grades
from ..functions.stats import arg_first, arg_last, avg_where, greater_or_false, r6, ratio, share_pct


def category_profile(df: DataFrame, key: str, measures: tuple[str, ...] = ("price",)) -> DataFrame:
    """``key, n, avg_<m>...`` per non-NULL key."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(m).alias(f"avg_{m}") for m in measures]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def frequency(df: DataFrame, key: str, by_key: bool = False) -> DataFrame:
    """Counts per key, most frequent first (or in key order)."""
    prof = category_profile(df, key, ())
    order = [F.col(key)] if by_key else [F.col("n").desc(), F.col(key)]
    return prof.orderBy(*order)


def mean_by(df: DataFrame, key: str, measure: str = "price") -> DataFrame:
    """Mean of ``measure`` per key, ascending by the mean (chart order)."""
    prof = category_profile(df, key, (measure,))
    return (prof.select(key, r6(F.col(f"avg_{measure}")).alias(f"avg_{measure}"))
                .orderBy(f"avg_{measure}", key))


def extremes(profile: DataFrame, key: str, measure: str | None = None) -> list[Column]:
    """Aggregate expressions over a profile: most / least common key and,
    with a measure, the keys of the highest and lowest mean."""
    n = F.col("n")
    out = [arg_first(key, -n).alias(f"most_common_{key}"),
           arg_last(key, -n).alias(f"least_common_{key}")]
    if measure:
        m = F.col(f"avg_{measure}")
        out += [arg_first(key, -m).alias(f"highest_priced_{key}"),
                arg_first(key, m).alias(f"lowest_priced_{key}")]
    return out


def color_profile(df: DataFrame) -> DataFrame:
    """Per color: count, mean carat, mean price, and price per carat as the
    ratio of the two means (not the mean of per-stone ratios)."""
    prof = category_profile(df, "color", ("carat", "price"))
    return prof.select(
        "color", "n",
        r6(F.col("avg_carat")).alias("avg_carat"),
        r6(F.col("avg_price")).alias("avg_price"),
        r6(ratio(F.col("avg_price"), F.col("avg_carat"))).alias("price_per_carat"))


def grade_shares(df: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """Percent of all rows whose ``key`` is in each named group; one pass."""
    return df.agg(*[r6(share_pct(F.col(key).isin(vals))).alias(name)
                    for name, vals in groups.items()])


def mean_exceeds(key: str, pair: tuple[str, str], measure: str = "price") -> Column:
    """mean(measure | key = pair[0]) > mean(measure | key = pair[1]); false if either is absent."""
    a, b = pair
    return greater_or_false(avg_where(measure, F.col(key) == a), avg_where(measure, F.col(key) == b))


def price_paradoxes(df: DataFrame) -> DataFrame:
    return df.agg(
        mean_exceeds("color", grades.COLOR_PARADOX).alias("color_price_paradox"),
        mean_exceeds("clarity", grades.CLARITY_PARADOX).alias("clarity_price_paradox"))


def cut_extremes(df: DataFrame) -> DataFrame:
    prof = category_profile(df, "cut", ("price",))
    return prof.agg(*extremes(prof, "cut", "price"))


def color_extremes(df: DataFrame) -> DataFrame:
    prof = category_profile(df, "color", ("carat", "price"))
    ppc = ratio(F.col("avg_price"), F.col("avg_carat"))
    return prof.agg(arg_first("color", -F.col("n")).alias("most_common_color"),
                    arg_first("color", -ppc).alias("best_value_color"))


def clarity_extremes(df: DataFrame) -> DataFrame:
    prof = category_profile(df, "clarity", ("price",))
    return prof.agg(arg_first("clarity", -F.col("n")).alias("most_common_clarity"),
                    arg_first("clarity", -F.col("avg_price")).alias("highest_priced_clarity"))
