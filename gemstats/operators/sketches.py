"""Quantiles of data that arrives in parts, from stored mergeable sketches.

Each arriving part is read once and leaves one KLL sketch a group (Spark's
``kll_sketch_agg``), appended to a Parquet table. Quantiles of everything so far
come from merging the sketches; no row is read again. A quantile's rank is off by
at most ``rank_error(k)`` of the rows with 99 % confidence, whatever their number
and however the parts were cut; ``rank_check`` measures it against the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attach import attach

K = 4000


def rank_error(k: int = K) -> float:
    """Normalised rank error of a KLL sketch with parameter k (its published
    single-sided bound)."""
    return 2.296 / k ** 0.9723


def sketch_parts(df: DataFrame, value: str, by: list[str], k: int = K) -> DataFrame:
    """by..., sketch: one KLL sketch of the values a group. NULLs are left out;
    a group without values has no row."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*by)
            .agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch")))


def add_part(df: DataFrame, value: str, by: list[str], path: str, k: int = K) -> None:
    """Sketch a part and append it to the table at ``path`` (one committed write)."""
    sketch_parts(df, value, by, k).write.mode("append").parquet(path)


def merged_quantiles(parts: DataFrame, probs: list[float], by: list[str], k: int = K) -> DataFrame:
    """by..., p, n, q for each probability, from the sketches of all parts."""
    whole = parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("s"))
    each = [F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("s", F.lit(float(p))).alias("q")) for p in probs]
    return (whole.select(*by, F.kll_sketch_get_n_double("s").alias("n"), F.explode(F.array(*each)).alias("e"))
            .select(*by, "e.p", "n", "e.q"))


def rank_check(df: DataFrame, value: str, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """by..., p, n, off: how far p lies outside the ranks that the quantile has
    among the rows, as a share of them (0 if it is exact)."""
    one = quantiles.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("p", "n", "q"))).alias("qs"))  # a few a group
    v = F.col(value).cast("double")
    rows = attach(df.filter(F.col(value).isNotNull()).select(*by, v.alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), one, by)
    ranks = (rows.select(*by, "_v", "_c", F.explode("qs").alias("w")).groupBy(*by, "w.p", "w.n", "w.q")
             .agg(F.sum("_c").alias("_all"), F.sum(F.when(F.col("_v") < F.col("w.q"), F.col("_c")).otherwise(0)).alias("_below"),
                  F.sum(F.when(F.col("_v") <= F.col("w.q"), F.col("_c")).otherwise(0)).alias("_upto")))
    off = F.greatest(F.col("_below") / F.col("_all") - F.col("p"), F.col("p") - F.col("_upto") / F.col("_all"), F.lit(0.0))
    return ranks.select(*by, "p", "n", off.alias("off"))
