"""Cumulative counts and exact quantiles without a global sort in one task.

A running count over a whole column is the textbook way to get an ECDF or
an exact quantile, and ``Window.orderBy`` without a partition puts every
row into one task. Here instead:

1. ``value_counts``: ``(group, value) -> n``; a partial aggregate, so a
   value held by a third of all rows arrives as one row per map task.
2. The counts are dealt out by range of (group, value), as many ranges as
   shuffle partitions (more if asked for), and written with the number of their range, so all
   branches below see the same ranges.
3. A running sum inside each (group, range).
4. A group that goes on in a later range needs the sums of the ranges
   before; at most one group goes over each range's edge, so this table has
   at most two rows a range and is broadcast. Offset + running sum is the
   exact cumulative count. What a value costs does not depend on the number
   of ranges.

The written table is in the shared folder; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attach import written

DEFAULT_BUCKETS = None  # None: as many ranges as the session's shuffle partitions


def bucket_count(spark, buckets: int | None) -> int:
    """Ranges of values: the session's shuffle partitions by default, so a
    range holds about distinct values / ranges rows however large the table."""
    return max(2, int(buckets or spark.conf.get("spark.sql.shuffle.partitions")))


def value_counts(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by..., value, n`` over non-NULL values (and non-NULL group keys)."""
    cond = F.col(value).isNotNull()
    for k in by:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def cumulative_counts(df: DataFrame, value: str, by: tuple[str, ...] = (),
                      buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """``by..., value, n, cum, total``: ``cum`` counts rows with a value <= this one."""
    parts = bucket_count(df.sparkSession, buckets)
    counts = written(value_counts(df, value, by).repartitionByRange(parts, *[F.col(f"`{k}`") for k in (*by, value)])
                     .withColumn("_range", F.spark_partition_id()))
    keys = "".join(f"`{k}`, " for k in by)
    own = counts.selectExpr(
        "*", f"sum(n) OVER (PARTITION BY {keys}_range ORDER BY `{value}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _cum",
        f"sum(n) OVER (PARTITION BY {keys}_range) AS _own")
    group = f"PARTITION BY {keys[:-2]} " if by else ""
    sums = counts.groupBy(*by, "_range").agg(F.sum("n").alias("_n")).selectExpr(
        *[f"`{k}`" for k in by], "_range", f"sum(_n) OVER ({group}ORDER BY _range) - _n AS _before",
        f"sum(_n) OVER ({group.strip()}) AS _total", f"count(1) OVER ({group.strip()}) AS _ranges")
    wide = sums.filter("_ranges > 1")  # at most two rows a range: its first group and its last
    return (own.join(F.broadcast(wide), [*by, "_range"], "left")
            .selectExpr(*[f"`{k}`" for k in by], f"`{value}`", "n", "coalesce(_before, 0) + _cum AS cum", "coalesce(_total, _own) AS total"))


def quantile_sql(value: str, p: float, method: str = "linear") -> str:
    """SQL aggregate over ``cumulative_counts`` rows giving one exact quantile.

    ``linear`` (Hyndman-Fan type 7, numpy's default): 0-based position
    h = (N - 1) p. ``hazen`` (type 5): h = N p - 1/2, clamped to [0, N - 1].
    The result interpolates linearly between the order statistics around h.
    """
    if method == "linear":
        h = f"(CAST(total - 1 AS DOUBLE) * {float(p)!r}D)"
    elif method == "hazen":
        h = f"least(greatest(CAST(total AS DOUBLE) * {float(p)!r}D - 0.5D, 0.0D), CAST(total - 1 AS DOUBLE))"
    else:
        raise ValueError(f"unknown quantile method {method!r}")
    v = f"`{value}`"
    lo = f"floor({h})"
    hi = f"least({lo} + 1, total - 1)"
    v_lo = f"max(CASE WHEN cum - n <= {lo} AND {lo} < cum THEN {v} END)"  # cum - n: rank of the first copy
    v_hi = f"max(CASE WHEN cum - n <= {hi} AND {hi} < cum THEN {v} END)"
    return f"{v_lo} + max({h} - {lo}) * ({v_hi} - {v_lo})"


def quantile_columns(value: str, probs: list[float], names: list[str], method: str = "linear") -> list[Column]:
    """Aggregates over ``cumulative_counts`` rows giving exact quantiles (see ``quantile_sql``)."""
    return [F.expr(f"{quantile_sql(value, p, method)} AS `{name}`") for p, name in zip(probs, names)]


def quantiles(df: DataFrame, value: str, probs: list[float], names: list[str] | None = None,
              by: tuple[str, ...] = (), method: str = "linear", buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """``by..., <name>...``: ``linear`` / ``hazen`` exact, or ``approx`` (sketch)."""
    if method == "approx":
        return approx_quantiles(df, value, probs, names, by)
    names = names or [f"q{int(round(p * 100)):02d}" for p in probs]
    cc = cumulative_counts(df, value, by, buckets)
    cols = quantile_columns(value, probs, names, method)
    return cc.groupBy(*by).agg(*cols) if by else cc.agg(*cols)


def exact_quantiles(df: DataFrame, value: str, probs: list[float], names: list[str] | None = None,
                    by: tuple[str, ...] = (), buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """``by..., <name>...`` exact type-7 quantiles per group (NULL on an empty group)."""
    return quantiles(df, value, probs, names, by, "linear", buckets)


def approx_quantiles(df: DataFrame, value: str, probs: list[float], names: list[str] | None = None,
                     by: tuple[str, ...] = (), accuracy: int = 10000) -> DataFrame:
    """Sketch-based quantiles (one partial aggregate) for when exact is not needed."""
    names = names or [f"q{int(round(p * 100)):02d}" for p in probs]
    arr = F.percentile_approx(value, probs, accuracy)
    agg = df.groupBy(*by).agg(arr.alias("_q")) if by else df.agg(arr.alias("_q"))
    return agg.select(*by, *[F.col("_q")[i].cast("double").alias(nm) for i, nm in enumerate(names)])
