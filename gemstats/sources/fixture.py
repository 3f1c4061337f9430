"""Synthetic diamond listings derived from the driver's ``lineitem`` table.

The view plants what the cleaning step must remove: repeated rows (every
line of an order whose key is divisible by 50 appears twice), missing cuts,
zero dimensions and the unmapped color ``K``. ``RAW_SQL`` is the same view
as SQL text for the DuckDB oracle; both produce identical rows.

The repeated copy is made with ``explode`` instead of a second scan plus
``UNION ALL``, so ``lineitem`` is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import ORDINAL, with_ordinal

RAW_COLUMNS = ["carat", "cut", "color", "clarity", "price", "x", "y", "z"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def diamond_raw_from(lineitem: DataFrame, *also: str) -> DataFrame:
    """The view's projection as SQL text (one call to the JVM to plan it);
    lines of an order whose key is divisible by 50 are emitted twice."""
    carat = "(l_quantity / 10)"
    return (lineitem.selectExpr(
                f"{carat} AS carat",
                "CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN CAST(NULL AS STRING)"
                " WHEN l_partkey % 5 = 0 THEN 'Fair' WHEN l_partkey % 5 = 1 THEN 'Good'"
                " WHEN l_partkey % 5 = 2 THEN 'Very Good' WHEN l_partkey % 5 = 3 THEN 'Premium'"
                " ELSE 'Ideal' END AS cut",
                "CASE WHEN l_linenumber = 7 AND l_tax = 0.07 THEN 'K'"
                " ELSE substring('DEFGHIJ', CAST(l_suppkey % 7 AS INT) + 1, 1) END AS color",
                "CASE CAST(l_orderkey % 8 AS INT) WHEN 0 THEN 'I1' WHEN 1 THEN 'SI2' WHEN 2 THEN 'SI1'"
                " WHEN 3 THEN 'VS2' WHEN 4 THEN 'VS1' WHEN 5 THEN 'VVS2' WHEN 6 THEN 'VVS1' ELSE 'IF' END AS clarity",
                "CAST(floor(l_quantity * 150 + l_extendedprice / 50) AS BIGINT) AS price",
                f"CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0.0D ELSE {carat} * 2 + 1 END AS x",
                f"{carat} * 2 + 1.5 AS y",
                f"{carat} + 0.5 AS z", *also,
                "explode(sequence(1, CASE WHEN l_orderkey % 50 = 0 THEN 2 ELSE 1 END)) AS _copy")
            .drop("_copy"))


def diamond_raw_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw listings with their row's place in the ``lineitem`` file."""
    return diamond_raw_from(with_ordinal(table(spark, sf_dir, "lineitem"), parquet=True), ORDINAL)


def diamond_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (dirty) diamond listings: carat, cut, color, clarity, price, x, y, z."""
    return diamond_raw_from(table(spark, sf_dir, "lineitem"))


def diamond_with_text_carat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings whose carat arrives as text with missing-value tokens.

    Tokens are planted by ``price % 10``: 0 -> ``NA``, 1 -> ``None``,
    2 -> empty, 3 -> ``nan``; other rows carry the number as text.
    """
    raw = diamond_raw(spark, sf_dir)
    p = F.col("price") % 10
    text = (F.when(p == 0, "NA").when(p == 1, "None").when(p == 2, "")
            .when(p == 3, "nan").otherwise(F.col("carat").cast("string")))
    return raw.withColumn("carat", text)


# The same view in SQL (runs unchanged in Spark SQL and DuckDB).
RAW_SQL = """base AS (
  SELECT l_orderkey, l_linenumber, l_discount, l_tax,
    l_quantity / 10 AS carat,
    CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN NULL
         WHEN l_partkey % 5 = 0 THEN 'Fair' WHEN l_partkey % 5 = 1 THEN 'Good'
         WHEN l_partkey % 5 = 2 THEN 'Very Good' WHEN l_partkey % 5 = 3 THEN 'Premium'
         ELSE 'Ideal' END AS cut,
    CASE WHEN l_linenumber = 7 AND l_tax = 0.07 THEN 'K'
         ELSE substr('DEFGHIJ', CAST(l_suppkey % 7 AS INT) + 1, 1) END AS color,
    CASE l_orderkey % 8 WHEN 0 THEN 'I1' WHEN 1 THEN 'SI2' WHEN 2 THEN 'SI1' WHEN 3 THEN 'VS2'
         WHEN 4 THEN 'VS1' WHEN 5 THEN 'VVS2' WHEN 6 THEN 'VVS1' ELSE 'IF' END AS clarity,
    CAST(floor(l_quantity * 150 + l_extendedprice / 50) AS BIGINT) AS price
  FROM lineitem),
dims AS (
  SELECT carat, cut, color, clarity, price,
    CASE WHEN l_discount = 0 AND l_tax = 0 THEN CAST(0 AS DOUBLE) ELSE carat * 2 + 1 END AS x,
    carat * 2 + 1.5 AS y, carat + 0.5 AS z, l_orderkey
  FROM base),
raw AS (
  SELECT carat, cut, color, clarity, price, x, y, z FROM dims
  UNION ALL
  SELECT carat, cut, color, clarity, price, x, y, z FROM dims WHERE l_orderkey % 50 = 0)"""
