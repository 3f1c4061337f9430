"""Line de-duplication: a distributed suffix array over sequences of line ids.

All documents, in order of doc_id, are one sequence of line ids (128-bit
hashes), cut at each document's end. A run of lines that occurs at an earlier
place too is deleted at the later one if it has at least ``min_chars``
characters; so every line of a document goes that lies in a repeated run, and
the first copy of each run stays.

Suffixes are ranked by prefix doubling: the rank of the first ``2h`` lines is
that of the pair (rank of the first h, rank of the h lines after them), where a
rank is the number of suffixes that sort before. Suffixes with equal ranks
are an interval of the suffix array whose common prefix has that length, and
the interval of exactly m lines comes from two overlapping ranks. A run long
enough is a union of shortest runs of ``min_chars`` characters (from a first
line on, or up to a last line), so the array is sorted only as deep as the
longest of these, and deeper rounds keep only documents that have such runs.

Ranks are made without a global sort in one task: pairs are counted, dealt out
by range, summed within each range, and shifted by the sums of the ranges
before. An interval's lines meet its first one in a salted join.

Defined cases: a null or empty text is one empty line and stays as it is;
lines end at LF only; repeated rows are documents of their own, in any order;
null ids come last; an empty table gives an empty result; other columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemstats.llm.common import salted_join, salts_used, small_batches, written

MIN_CHARS = 20


def shortest_runs(chars: np.ndarray, min_chars: int) -> list[list[int]]:
    """For each first line the lengths of its shortest runs: the one that
    first reaches min_chars, and those that some last line reaches back for."""
    total = np.concatenate([[0], np.cumsum(chars)])
    n = len(chars)
    out: list[set[int]] = [set() for _ in range(n)]
    stop = np.searchsorted(total, total[:-1] + min_chars, "left")  # one past the last line
    for i in np.flatnonzero(stop <= n):
        out[i].add(max(1, int(stop[i] - i)))
    begin = np.searchsorted(total, total[1:] - min_chars, "right") - 1
    for last in np.flatnonzero(total[1:] >= min_chars):
        first = min(int(begin[last]), int(last))
        out[first].add(int(last - first + 1))
    return [sorted(x) for x in out]


def _lines(min_chars: int, at_most: int = 1 << 16):
    kind = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("a", pa.int64()), ("b", pa.int64()),
                      ("runs", pa.list_(pa.int32()))])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in kind]

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)
            for c in cols:
                c.clear()
            return batch

        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                own = (text or "").split("\n")
                runs = shortest_runs(np.array([len(x) for x in own], np.int64), min_chars)
                for i, x in enumerate(own):
                    h = xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"))
                    for c, v in zip(cols, (row, doc_id, i, int.from_bytes(h[:8], "big", signed=True),
                                           int.from_bytes(h[8:], "big", signed=True), runs[i]), strict=True):
                        c.append(v)
                    if len(cols[0]) >= at_most:
                        yield out()
        yield out()

    return lines


def ranks(pairs: DataFrame, *also: Column) -> DataFrame:
    """a, b, rank (how many rows have a smaller pair), n for each pair (a, b),
    and what else is aggregated."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = written(pairs.groupBy("a", "b").agg(F.count("*").alias("n"), *also)
                      .repartitionByRange(parts, "a", "b").withColumn("part", F.spark_partition_id()), "ranks")
    # one row a range
    before = (counted.groupBy("part").agg(F.sum("n").alias("all"))
              .selectExpr("part", "sum(all) over (order by part) - all as before"))
    own = F.expr("sum(n) over (partition by part order by a, b) - n")
    return (counted.withColumn("own", own).join(F.broadcast(before), "part")
            .withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before"))


def _ranked(suffixes: DataFrame) -> DataFrame:
    """suffixes(a, b, ...) with rank instead of the pair, written."""
    place = F.xxhash64("row", "line")
    return written(salted_join(suffixes, ranks(suffixes, salts_used(place)), ["a", "b"], place)
                   .drop("a", "b", "n"), "suffixes")


def repeated_runs(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """row, first, m of the shortest runs that occur earlier too, of
    rows(row, doc_id, text) with distinct row."""
    small_batches(rows.sparkSession)
    lines = rows.select("row", "doc_id", "text").mapInArrow(
        _lines(min_chars), "row bigint, doc_id bigint, line int, a bigint, b bigint, runs array<int>")
    at = _ranked(written(lines, "lines"))
    deepest = at.agg(F.max(F.array_max("runs"))).first()[0] or 0
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line")
    found, h = None, 1
    while h <= deepest:
        runs = (at.select("row", "line", "doc_id", "rank", F.explode(F.filter("runs", lambda m: (m >= h) & (m < 2 * h))).alias("m")))
        if h > 1:  # the last h lines of the run overlap its first h
            other = at.select("row", (F.col("line")).alias("at"), F.col("rank").alias("rank2"))
            runs = runs.withColumn("at", F.col("line") + F.col("m") - h).join(other, ["row", "at"])
        else:
            runs = runs.withColumn("rank2", F.col("rank"))
        intervals = (runs.groupBy("m", "rank", "rank2").agg(F.count("*").alias("n"), F.min(place).alias("head"),
                                                                 salts_used(F.xxhash64("row", "line"))).filter("n > 1"))
        later = (salted_join(runs, intervals, ["m", "rank", "rank2"], F.xxhash64("row", "line"))
                 .filter((F.col("head.row") != F.col("row")) | (F.col("head.line") != F.col("line")))
                 .select("row", F.col("line").alias("first"), "m"))
        found = later if found is None else found.unionByName(later)
        h *= 2
        if h <= deepest:
            # after a document's end comes -1; documents without a run this long are done
            ahead = (at.withColumn("b", F.expr(f"coalesce(lead(rank, {h // 2}) over (partition by row order by line), -1)"))
                     .withColumn("deep", F.expr("max(array_max(runs)) over (partition by row)")).filter(F.col("deep") >= h))
            at = _ranked(ahead.select("row", "doc_id", "line", "runs", F.col("rank").alias("a"), "b"))
    if found is None:
        return rows.select("row", F.lit(0).alias("first"), F.lit(0).alias("m")).limit(0)
    return found


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_deleted, text (without the deleted lines; empty if
    all went) of each row."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")
    spans = written(repeated_runs(rows, min_chars), "runs").groupBy("row").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("first"), F.col("first") + F.col("m") - 1)))).alias("gone"))
    held = rows.join(spans, "row", "left").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")
    return held.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
                       F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
