"""Dense numbers 0 .. n - 1 in a given order, without a window over all rows.

Rows are dealt out by range of the order and sorted within each range; a row's
place in its range is its place in the sorted task. The ranges' sizes, one row a
range, give each range's first number. Ties are split by the rows' places in the
input, so that many equal keys don't make one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attach import written

#: The lower bits of ``monotonically_increasing_id``: a row's place in its task.
PLACE = (1 << 33) - 1


def ranges_of(spark) -> int:
    """As many ranges as shuffle partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, written, with ``_range`` (ranges follow the order) and ``_place``
    (0-based place in the range). Equal rows may lie in several ranges."""
    dealt = (df.withColumn("_tie", F.monotonically_increasing_id())
             .repartitionByRange(ranges_of(df.sparkSession), *order, "_tie").sortWithinPartitions(*order, "_tie"))
    return written(dealt.drop("_tie").select("*", F.spark_partition_id().alias("_range"),
                                             F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE)).alias("_place")))


def numbered(df: DataFrame, order: list[Column], name: str = "no") -> DataFrame:
    """df with the column ``name`` (bigint) first: 0 for the first row in
    ``order``, up to the number of rows less one."""
    rows = ranged(df, order)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row a range, so at most as many as shuffle partitions
    first = sizes.selectExpr("_range", "sum(_n) over (order by _range) - _n as _first")
    return (rows.join(F.broadcast(first), "_range")
            .select((F.col("_first") + F.col("_place")).alias(name), *[f"`{c}`" for c in df.columns]))
