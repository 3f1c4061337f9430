"""Counts for moving sliders: a summed-area table over price x carat bins.

The table is binned once by price and carat (edges at approximate quantiles, so
bins hold about as many rows each). For each combination of grades a summed-area
table says how many rows lie in the bins up to (p, c); the rows of any rectangle
of whole bins then come from its four corners. The bins that a slider's end cuts
are counted from the rows, of which two narrow copies are kept, in folders by
price bin and by carat bin, so that only the cut bins are read: at most four of
``bins`` folders, whatever the table's size. Counts are exact.

The summed-area table has bins^2 rows a combination of grades, whatever the
number of rows; its edges, ``bins - 1`` numbers an axis, are all that the driver
holds.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import diamond_predicate

GRADES = ("cut", "color", "clarity")
BINS = 64


def _edges(df: DataFrame, column: str, bins: int) -> list[float]:
    probs = [i / bins for i in range(1, bins)]
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), probs, 100 * bins)).first()[0]
    return sorted(set(found or []))


def _bin_sql(column: str, edges: list[float]) -> str:
    """How many edges are at most the value, by halving."""
    def within(lo: int, hi: int) -> str:  # the bin is known to be in [lo, hi]
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if(CAST(`{column}` AS DOUBLE) < {edges[mid]!r}D, {within(lo, mid)}, {within(mid + 1, hi)})"

    return within(0, len(edges))


class FilterCube:
    """The stored tables: ``sat`` (grades, pb, cb, upto), ``by_pb`` and ``by_cb``
    (carat, price, grades, n, pb, cb), and the edges."""

    def __init__(self, spark: SparkSession, path: str, edges: dict[str, list[float]], total: int):
        self.spark, self.path, self.edges, self.total = spark, path.rstrip("/"), edges, total

    @classmethod
    def build(cls, df: DataFrame, path: str, bins: int = BINS) -> "FilterCube":
        """Rows without a price, a carat or a grade are in the total alone, as no
        filter on all of them keeps them."""
        spark, path = df.sparkSession, path.rstrip("/")
        edges = {c: _edges(df, c, bins) for c in ("price", "carat")}
        binned = (df.groupBy("price", "carat", *GRADES).agg(F.count(F.lit(1)).alias("n")).na.drop()
                  .selectExpr("*", f"{_bin_sql('price', edges['price'])} AS pb", f"{_bin_sql('carat', edges['carat'])} AS cb"))
        binned.repartition("pb").write.partitionBy("pb").parquet(f"{path}/by_pb")
        rows = spark.read.parquet(f"{path}/by_pb")
        rows.repartition("cb").write.partitionBy("cb").parquet(f"{path}/by_cb")
        cells = rows.groupBy(*GRADES, "pb", "cb").agg(F.sum("n").alias("n"))
        keys = ", ".join(GRADES)
        grid = (cells.select(*GRADES).distinct()
                .selectExpr("*", f"explode(sequence(0, {len(edges['price'])})) AS pb")
                .selectExpr("*", f"explode(sequence(0, {len(edges['carat'])})) AS cb"))
        sat = (grid.join(cells, [*GRADES, "pb", "cb"], "left")
               .selectExpr(*GRADES, "pb", "cb", f"sum(coalesce(n, 0)) OVER (PARTITION BY {keys}, pb ORDER BY cb) AS row_sum")
               .selectExpr(*GRADES, "pb", "cb", f"sum(row_sum) OVER (PARTITION BY {keys}, cb ORDER BY pb) AS upto"))
        sat.sortWithinPartitions("pb", "cb").write.parquet(f"{path}/sat")
        return cls(spark, path, edges, df.count())

    def _bins(self, column: str, bounds: tuple | None) -> tuple[int, int, list[int]]:
        """First and last whole bin of a range, and the bins that its ends cut."""
        edges, (lo, hi) = self.edges[column], bounds or (None, None)
        first = 0 if lo is None else bisect_right(edges, lo)
        last = len(edges) if hi is None else bisect_right(edges, hi)
        if first > last:
            return 1, 0, []
        cut = {last} if hi is not None else set()
        if lo is not None and not (first and edges[first - 1] == lo):
            cut.add(first)
        whole = [b for b in (first, last) if b in cut]
        return first + (first in cut), last - (last in cut), sorted(set(whole))

    def counts(self, price: tuple | None = None, carat: tuple | None = None, colors: list | None = None,
               clarities: list | None = None, cuts: list | None = None) -> DataFrame:
        """n_filtered, n_total, as ``filters.filter_counts`` gives them."""
        p0, p1, p_cut = self._bins("price", price)
        c0, c1, c_cut = self._bins("carat", carat)
        grades = diamond_predicate(colors=colors, clarities=clarities, cuts=cuts)
        exact = diamond_predicate(price=price, carat=carat)
        sat = self.spark.read.parquet(f"{self.path}/sat").filter(grades)
        corner = (F.when(F.col("pb") == p1, 1).otherwise(-1) * F.when(F.col("cb") == c1, 1).otherwise(-1)) * F.col("upto")
        inner: Column = F.lit(False)
        if p0 <= p1 and c0 <= c1:
            inner = F.col("pb").isin([b for b in (p0 - 1, p1) if b >= 0]) & F.col("cb").isin([b for b in (c0 - 1, c1) if b >= 0])
        parts = [sat.filter(inner).select(corner.alias("n"))]
        if p_cut:
            parts.append(self.spark.read.parquet(f"{self.path}/by_pb").filter(F.col("pb").isin(p_cut) & exact & grades).select("n"))
        if c_cut and p0 <= p1:
            parts.append(self.spark.read.parquet(f"{self.path}/by_cb")
                         .filter(F.col("cb").isin(c_cut) & F.col("pb").between(p0, p1) & exact & grades).select("n"))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_filtered"), F.lit(self.total).cast("bigint").alias("n_total"))
