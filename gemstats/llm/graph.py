"""Connected components of an edge table by alternating star contraction.

Each round every node is linked to the smallest of its neighbours (first over
larger, then over smaller neighbours), so paths halve and the edges end as
stars around the smallest node. Every round is written to the shared folder;
hub nodes are split by a salted join. Nothing goes through the driver but two
sums a round, which tell when the edges stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemstats.llm.common import remove, salted_join, salts_used, written


def _large_star(edges: DataFrame, salts: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), salts_used(F.col("b"), salts))
    return (salted_join(both.filter("b > a"), least, ["a"], F.col("b"), salts)
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b"))


def _small_star(edges: DataFrame, salts: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), salts_used(F.col("b"), salts))
    linked = salted_join(down, least, ["a"], F.col("b"), salts)
    return (linked.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                            F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a != b").distinct())


def components(edges: DataFrame, salts: int = 8) -> DataFrame:
    """node, root for each node of ``edges(a, b)`` other than the roots
    themselves; root is the smallest node reachable. Loops are ignored, null
    ends must not occur; an empty table gives an empty result."""
    at = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                 "edges")
    seen = None
    while True:
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, previous = now, at
        at = written(_small_star(_large_star(previous, salts), salts), "edges")
        remove(previous)
