"""Records of CSV files whose quoted cells may hold line breaks.

Spark splits a text file at line breaks, so a cell with one is cut in two, and
reading a whole file in one task (``multiLine``) gives up splitting. Here the
lines stay split, and a pass over the quotes decides which lines begin a record.

A line changes whether one is inside a quoted cell; what it does depends on how
it is entered, so each line is a function from (outside, inside) to (outside,
inside): it either turns the state, keeps it, or sets it whatever it was. Such
functions compose, within a block by running sums, and over blocks by the same
sums over one row a block, which gives the state at each block's start. A line
entered from outside begins a record, and the records before a block are counted
likewise, so records are numbered in file order and the lines of a record meet by
its number, over block edges too. What is summed as a block is a piece of one, of
at most ``PIECE`` lines, so that no task sorts all lines of a block, however large
blocks are. A file that ends inside a quoted cell is refused. Lines end at LF or CR LF; a lone CR is part of a cell.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.attach import attach, written
from .order import ORDINAL

PIECE = 1 << 16  # lines that are summed at once
TASK_LINES = 1 << 18  # about what a task gets

UNIT = ["file", "block", "piece"]

# Quoted sections, and cells that don't begin with a quote (whose quotes are
# plain characters): what is left holds a quote if the line ends inside a cell.
_SETTLED = r"""'"[^"]*+"|(^|,)[^",][^,]*+'"""


def _ends_inside(text: str) -> str:
    """SQL: 1 if a line entered from outside ends inside a quoted cell."""
    return f"if(contains({text}, '\"'), regexp_count(regexp_replace({text}, {_SETTLED}, ''), '\"') % 2, 0)"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, piece, place, value; t0, t1: whether the line ends inside a cell
    if entered from outside, from inside."""
    text = spark.read.option("lineSep", "\n").text(path)
    return (text.selectExpr("_metadata.file_path as file", "_metadata.file_block_start as block",
                            "monotonically_increasing_id() as place", "value")
            .selectExpr("*", f"place div {PIECE} as piece", f"{_ends_inside('value')} as t0", f"""{_ends_inside("concat('\"', value)")} as t1""")
            .selectExpr("*", "t0 = t1 as sets", "if(t0 = t1, 0, t0) as turns"))


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether any cell goes on over a line's end: one pass, whose regular
    expressions see only lines with a quote."""
    text = spark.read.option("lineSep", "\n").text(path)
    return bool(text.agg(F.max(F.expr(_ends_inside("value")))).first()[0])


def _dealt(lines: DataFrame) -> DataFrame:
    """The written lines by pieces, over as many tasks as there are lines for."""
    least = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(max(least, -(-lines.count() // TASK_LINES)), *UNIT)


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """record (0, 1, ... in file order), file_no (from 1), first (whether it
    begins a file) and value, its text with the line breaks of its cells."""
    lines = written(_lines(spark, path))
    inside = "partition by file, block, piece order by place"
    summed = _dealt(lines).selectExpr("*", f"sum(turns) over ({inside}) as turned")
    # a piece's function, as a line's: sets to ``t`` or turns ``turns`` times
    pieces = summed.groupBy(*UNIT).agg(
        F.sum("turns").alias("all_turns"), F.max(F.expr("if(sets, struct(place, t0, turned), null)")).alias("s")).selectExpr(
        *UNIT, "s is not null as sets", "if(s is null, null, (s.t0 + all_turns - s.turned) % 2) as t",
        "if(s is null, all_turns % 2, 0) as turns")
    over = "over (partition by file order by block, piece"
    pieces = pieces.selectExpr("*", f"sum(turns) {over}) as turned").selectExpr(
        "*", f"last(if(sets, struct(t, turned), null), true) {over} rows between unbounded preceding and 1 preceding) as s").selectExpr(
        *UNIT, "(coalesce(s.t, 0) + turned - turns - coalesce(s.turned, 0)) % 2 as entered", "sets", "t", "turns")
    pieces = written(pieces)
    open_files = (pieces.withColumn("out", F.expr("if(sets, t, (entered + turns) % 2)"))
                  .groupBy("file").agg(F.max(F.struct("block", "piece", "out")).alias("e")).filter("e.out = 1").select("file"))
    bad = open_files.first()
    if bad is not None:
        raise ValueError(f"{bad.file} ends inside a quoted cell")
    states = attach(summed, pieces.select(*UNIT, "entered"), UNIT).selectExpr(
        "*", f"last(if(sets, struct(t0, turned), null), true) over ({inside} rows between unbounded preceding and 1 preceding) as s").selectExpr(
        *UNIT, "place", "value", "if(s is null, entered + turned - turns, s.t0 + turned - turns - s.turned) % 2 = 0 as starts", "t0").filter(
        "not (starts and value in ('', '\\r'))")  # blank lines are no records
    states = written(states.selectExpr("*", f"sum(if(starts, 1, 0)) over ({inside}) as nth"))
    # one row a piece, in file order
    before = states.groupBy(*UNIT).agg(F.count_if("starts").alias("n")).selectExpr(
        *UNIT, "sum(n) over (order by file, block, piece) - n as before",
        "sum(n) over (partition by file order by block, piece) - n as before_in_file", "dense_rank() over (order by file) as file_no")
    placed = attach(states, before, UNIT).selectExpr(
        "before + nth - 1 as record", "file_no", "before_in_file + nth = 1 as first", "place", "file", "block", "value", "starts and t0 = 0 as whole")
    one = placed.filter("whole").select("record", "file_no", "first", "value")
    parts = (placed.filter("not whole").groupBy("record")
             .agg(F.max("file_no").alias("file_no"), F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("file", "block", "place", "value"))).alias("l"))
             .selectExpr("record", "file_no", "first", "array_join(transform(l, x -> x.value), '\\n') as value"))
    return one.unionByName(parts).withColumn("value", F.regexp_replace("value", "\\r$", ""))


def header_names(line: str) -> list[str]:
    """Column names of a header as Spark's reader gives them: blank ones by their
    place, repeated ones with it."""
    cells = next(csv.reader([line]))
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_records(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """The cells of CSV files with a header, as text, whatever line breaks
    they hold; ``ordered`` adds the record's number, headers not counted, as the ordinal."""
    records = numbered_records(spark, path)
    header = records.filter("first").orderBy("record").first()
    if header is None:
        raise ValueError(f"{path} is empty")
    names = header_names(header.value)
    kind = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    cells = F.from_csv("value", kind.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
    rows = records.filter("not first").select((F.col("record") - F.col("file_no")).alias(ORDINAL), cells.alias("c"))
    out = [F.col(f"c.c{i}").alias(n) for i, n in enumerate(names)]
    return rows.select(*out, *([ORDINAL] if ordered else []))
