"""The data behind each chart: histogram, ECDF, box plot, scatter.

Charts of the statistics being mirrored are drawn from all raw rows; here
the chart *data* is computed on the cluster and only small tables (or a
bounded sample) come out.

Histogram bins: the statistics only cap the bin count, so the edges are
our choice: step = the smallest of {1, 2, 5} x 10^k that is >= range/bins
and keeps the bin count within the cap, origin = floor(min/step)*step,
half-open bins; one bin when min = max or when no step keeps to the cap (a cap
of 1 with values on both sides of zero). The bin parameters are a one-row
aggregate inlined as a scalar subquery: no join, no driver round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grades
from ..functions.stats import DIGITS, r6
from .attach import attach, written
from .ranks import DEFAULT_BUCKETS, cumulative_counts, quantile_columns

# k of m x 10^k runs from floor(log10(range / cap)), so 1..10 always holds a step
# of at least range / cap; the larger ones are for ranges that straddle one more
# edge than they have bins, and the last (2 x range) serves any cap of two or more.
STEP_MULTIPLIERS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000)


def bin_index_sql(v: str, origin: str, step: str) -> str:
    # round before floor: (0.3 - 0.0) / 0.1 is 2.9999999999999996
    return f"floor(round(({v} - {origin}) / {step}, 9))"


def bin_index(v: Column, origin: Column, step: Column) -> Column:
    return F.floor(F.round((v - origin) / step, 9))


def step_sql(lo: str, hi: str, max_bins: int) -> str:
    """SQL for the bin width of the value range [lo, hi] (columns of a one-row
    table): the smallest candidate m x 10^k (exact integer powers, so every
    engine agrees) that covers the range within the cap; 1 when lo = hi."""
    raw = f"(({hi} - {lo}) / {float(max_bins)!r}D)"
    k = f"floor(log10({raw}))"
    scaled = f"CASE WHEN {k} >= 0 THEN CAST(m AS DOUBLE) * pow(10.0D, {k}) ELSE CAST(m AS DOUBLE) / pow(10.0D, -{k}) END"
    fits = (f"filter(transform(array({', '.join(str(m) for m in STEP_MULTIPLIERS)}), m -> {scaled}), "
            f"st -> st >= {raw} AND {bin_index_sql(hi, f'floor({lo} / st) * st', 'st')} + 1 <= {max_bins})")
    # one bin that starts at the minimum if nothing else fits (a cap of 1 around zero)
    return f"CASE WHEN {hi} > {lo} THEN coalesce(array_min({fits}), -1.0D) WHEN {hi} = {lo} THEN 1.0D END"


def origin_sql(lo: str, hi: str, step: str) -> str:
    return f"CASE WHEN {hi} = {lo} OR {step} < 0 THEN {lo} ELSE floor({lo} / {step}) * {step} END"


def _span(df: DataFrame, value: str, max_bins: int) -> DataFrame:
    """One row: step, origin, bins of the finite values (NULLs when none). A
    negative step stands for one bin from the minimum to the maximum."""
    return (df.agg(F.min(finite(value)).cast("double").alias("lo"), F.max(finite(value)).cast("double").alias("hi"))
              .selectExpr("lo", "hi", f"{step_sql('lo', 'hi', max_bins)} AS step")
              .selectExpr(f"{origin_sql('lo', 'hi', 'step')} AS origin", "step", "lo", "hi")
              .selectExpr("origin", "CASE WHEN step < 0 THEN hi - lo ELSE step END AS step",
                          f"CAST(CASE WHEN step < 0 THEN 1 ELSE {bin_index_sql('hi', 'origin', 'step')} + 1 END AS INT) AS bins"))


def finite(value: str) -> Column:
    """The value; NULL for infinities and NaN, which no bin can hold."""
    d = F.col(value).cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), F.col(value))


def histogram(df: DataFrame, value: str, max_bins: int) -> DataFrame:
    """``bin, bin_start, bin_end, n`` for every bin, empty ones included.

    One min/max aggregate gives the bins; then rows are binned before the
    partial aggregate, so a task shuffles at most one record per bin, however
    many distinct values there are. Infinities are counted in no bin."""
    params = _span(df, value, max_bins)
    p = params.select(F.struct("step", "origin", "bins")).scalar()
    raw = bin_index(F.col(value), p.getField("origin"), p.getField("step")).cast("int")
    bin_of = F.least(F.greatest(raw, F.lit(0)), p.getField("bins") - 1)  # the maximum of a single bin
    counts = (df.filter(finite(value).isNotNull()).select(F.coalesce(bin_of, F.lit(-1)).alias("bin"))
                .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    all_bins = params.where("bins IS NOT NULL").selectExpr("step", "origin", "explode(sequence(0, bins - 1)) AS bin")
    return (all_bins.join(counts, "bin", "left")
                    .selectExpr("bin",
                                f"round(origin + bin * step, {DIGITS}) AS bin_start",
                                f"round(origin + (bin + 1) * step, {DIGITS}) AS bin_end",
                                "CAST(coalesce(n, 0) AS BIGINT) AS n"))


def ecdf_values(df: DataFrame, value: str = "carat", buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """One ECDF point per distinct value: ``value, n, cum, pct`` (pct = cum / N * 100)."""
    cc = cumulative_counts(df, value, (), buckets)
    return cc.select(value, "n", "cum",
                     r6(F.col("cum").cast("double") / F.col("total") * 100).alias("pct"))


def ecdf_rows(df: DataFrame, value: str = "carat", buckets: int | None = DEFAULT_BUCKETS,
              chunk: int = 1 << 16, partitions: int | None = None) -> DataFrame:
    """One ECDF point per row, as the chart of the statistics draws it:
    ``value, position (1..N), pct = position / N * 100``.

    Each distinct value expands to its ``n`` positions. A value held by a
    huge share of rows is first split into chunks of at most ``chunk``
    positions; the chunk descriptors are hash-spread over ``partitions``
    tasks (an explicit count, so adaptive execution keeps them apart) and
    only then expanded, so no task emits more than its share.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cc = cumulative_counts(df, value, (), buckets)
    first = F.col("cum") - F.col("n") + 1
    chunks = cc.select(value, first.alias("_first"), "cum", "total",
                       F.explode(F.sequence(F.lit(0).cast("bigint"),
                                            F.floor((F.col("n") - 1) / chunk))).alias("_c"))
    chunks = chunks.repartition(parts, F.col(value), F.col("_c"))
    lo = F.col("_first") + F.col("_c") * chunk
    hi = F.least(F.col("cum"), lo + chunk - 1)
    rows = chunks.select(value, "total", F.explode(F.sequence(lo, hi)).alias("position"))
    return rows.select(value, "position",
                       r6(F.col("position").cast("double") / F.col("total") * 100).alias("pct"))


def ecdf_thresholds(df: DataFrame, value: str = "carat",
                    pct_line: float = grades.ECDF_PERCENT_LINE,
                    value_line: float = grades.ECDF_CARAT_LINE,
                    buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """Smallest value whose cumulative percent reaches ``pct_line``, and the
    cumulative percent at ``value_line``."""
    cc = cumulative_counts(df, value, (), buckets)
    pct = F.col("cum").cast("double") / F.col("total") * 100
    v = F.col(value)
    return cc.agg(F.min(F.when(pct >= pct_line, v)).alias(f"{value}_at_pct_line"),
                  r6(F.coalesce(F.max(F.when(v <= value_line, pct)), F.lit(0.0))).alias("pct_at_value_line"))


def _fences(counts: DataFrame, value: str, key: str, whisker: float, method: str) -> DataFrame:
    q = counts.groupBy(key).agg(F.max("total").alias("n"),
                                *quantile_columns(value, [0.25, 0.5, 0.75], ["q1", "median", "q3"], method))
    iqr = F.col("q3") - F.col("q1")
    return q.select(key, "n", "q1", "median", "q3",
                    (F.col("q1") - F.lit(whisker) * iqr).alias("lower_fence"),
                    (F.col("q3") + F.lit(whisker) * iqr).alias("upper_fence"))


def box_fences(df: DataFrame, value: str = "price", key: str = "clarity",
               whisker: float = 1.5, buckets: int | None = DEFAULT_BUCKETS, method: str = "linear") -> DataFrame:
    """Per key: n, quartiles (``linear`` = type 7, ``hazen`` = type 5) and the
    ``whisker`` x IQR fences."""
    return _fences(cumulative_counts(df, value, (key,), buckets), value, key, whisker, method)


def box_stats(df: DataFrame, value: str = "price", key: str = "clarity",
              whisker: float = 1.5, buckets: int | None = DEFAULT_BUCKETS, method: str = "linear") -> DataFrame:
    """Per key: n, quartiles, fences, whisker ends and the number of
    outliers. All of it comes from the cumulative counts (one row per key and
    distinct value), written once; the fences reach them as a side table."""
    counts = written(cumulative_counts(df, value, (key,), buckets))
    v = F.col(value)
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    r = attach(counts.select(key, value, F.col("n").alias("_n")), _fences(counts, value, key, whisker, method), [key])
    named = ("q1", "median", "q3", "lower_fence", "upper_fence")
    return (r.groupBy(key).agg(F.max("n").alias("n"), *[r6(F.max(c)).alias(c) for c in named],
                               F.min(F.when(inside, v)).cast("double").alias("whisker_low"),
                               F.max(F.when(inside, v)).cast("double").alias("whisker_high"),
                               F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).cast("bigint").alias("outliers")))


def box_outliers(df: DataFrame, value: str = "price", key: str = "clarity",
                 whisker: float = 1.5, buckets: int | None = DEFAULT_BUCKETS, method: str = "linear") -> DataFrame:
    """The rows outside their group's fences (the dots of the box plot). The
    fences, one row per key, are the side that travels."""
    fences = box_fences(df, value, key, whisker, buckets, method).select(key, "lower_fence", "upper_fence")
    v = F.col(value)
    rows = df.filter(F.col(key).isNotNull() & v.isNotNull())
    return attach(rows, fences, [key]).filter((v < F.col("lower_fence")) | (v > F.col("upper_fence")))


def scatter_density(df: DataFrame, x: str = "carat", y: str = "price",
                    x_bins: int = grades.CARAT_BINS, y_bins: int = grades.PRICE_BINS) -> DataFrame:
    """2-D binned counts of the price-vs-carat scatter: non-empty cells only.

    Two reads, both with tiny shuffles: one min/max aggregate gives both
    axes' bins (one scalar subquery), then every row is binned and the
    cells are counted with partial aggregation (at most x_bins * y_bins
    records per task, whatever the number of distinct (x, y) pairs)."""
    both = df.filter(finite(x).isNotNull() & finite(y).isNotNull())
    ext = both.agg(F.min(x).cast("double").alias("xl"), F.max(x).cast("double").alias("xh"),
                   F.min(y).cast("double").alias("yl"), F.max(y).cast("double").alias("yh"))
    one = "CASE WHEN {0}s < 0 THEN {0}h - {0}l ELSE {0}s END AS {0}s"  # a single bin over the whole range
    params = (ext.selectExpr("xl", "xh", "yl", "yh", f"{step_sql('xl', 'xh', x_bins)} AS xs",
                             f"{step_sql('yl', 'yh', y_bins)} AS ys")
                 .selectExpr(one.format("x"), f"{origin_sql('xl', 'xh', 'xs')} AS xo", "xs < 0 AS x1",
                             one.format("y"), f"{origin_sql('yl', 'yh', 'ys')} AS yo", "ys < 0 AS y1"))
    p = params.select(F.struct("xs", "xo", "x1", "ys", "yo", "y1")).scalar()
    bx, by = (F.when(p.getField(f"{k}1"), 0).otherwise(bin_index(F.col(c), p.getField(f"{k}o"), p.getField(f"{k}s"))).cast("int")
              for k, c in (("x", x), ("y", y)))
    cells = (both.select(F.coalesce(bx, F.lit(-1)).alias(f"{x}_bin"), F.coalesce(by, F.lit(-1)).alias(f"{y}_bin"))
                 .groupBy(f"{x}_bin", f"{y}_bin").agg(F.count(F.lit(1)).alias("n")))
    return cells.select(
        f"{x}_bin", f"{y}_bin",
        r6(p.getField("xo") + F.col(f"{x}_bin") * p.getField("xs")).alias(f"{x}_start"),
        r6(p.getField("yo") + F.col(f"{y}_bin") * p.getField("ys")).alias(f"{y}_start"),
        "n")


def scatter_points(df: DataFrame, x: str = "carat", y: str = "price") -> DataFrame:
    """Every point of the scatter: one row per row that has both values."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)


def scatter_sample(df: DataFrame, fraction: float, x: str = "carat", y: str = "price", seed: int = 42) -> DataFrame:
    """A reproducible share of the scatter points for a display that can't draw
    all: a row is kept when the hash of its content falls below ``fraction``."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 30))
    return df.filter(h < F.lit(int(fraction * (1 << 30)))).select(x, y)
