"""The order of rows in their source files, as a column.

A row's ordinal is made at the read from the file's place among the sorted
paths, the start of its block in the file, and its place in the block (for
Parquet: the row's index in the file, which needs no block). Tasks read blocks in
any order; the ordinal says where a row stood, whatever they do. It is a number
to sort by, not a count: gaps are left between blocks and files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDINAL = "_ordinal"
#: A file has less than 2^40 bytes and rows, a task less than 2^33 rows.
FILE_BITS, TASK_BITS = 40, 33
MAX_NAMED_FILES = 1000


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "file:/", path)


def _file_number(df: DataFrame) -> Column:
    """The file's place among the sorted paths of the frame's files; by a hash of
    its path if there are too many to name in the plan."""
    files = sorted({_plain(f) for f in df.inputFiles()})
    if len(files) <= 1:
        return F.lit(0).cast("bigint")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    if len(files) <= MAX_NAMED_FILES:
        return F.array_position(F.array(*[F.lit(f) for f in files]), path)
    return F.pmod(F.xxhash64(path), F.lit(1 << 22))


def with_ordinal(df: DataFrame, parquet: bool) -> DataFrame:
    """A frame that reads files directly, with ``_ordinal`` last: a bigint for
    Parquet, decimal(38,0) for text formats, whose rows have no index."""
    number = _file_number(df)
    if parquet:
        return df.select("*", (F.shiftleft(number, FILE_BITS) + F.col("_metadata.row_index")).alias(ORDINAL))
    block = (F.shiftleft(number, FILE_BITS) + F.col("_metadata.file_block_start")).cast("decimal(38,0)")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    return df.select("*", (block * F.lit(1 << TASK_BITS).cast("decimal(18,0)") + place).cast("decimal(38,0)").alias(ORDINAL))


def without_ordinal(df: DataFrame) -> DataFrame:
    return df.drop(ORDINAL)
