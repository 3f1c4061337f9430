"""Cleaning and enrichment of raw listings.

Steps run in this order, each a lazy DataFrame transform:
drop saved index -> drop exact duplicates -> drop rows with a missing
value -> drop non-positive dimensions -> add grade ordinals.

Mapping runs last, so an unknown grade leaves a NULL ordinal and the row
stays. The two filters are written after the de-duplication, as in the
statistics being mirrored; Catalyst moves them below the aggregate (and
into the Parquet scan), so the shuffle carries only surviving rows. The
de-duplication is a hash aggregate with a map-side partial step: a row
repeated a billion times leaves each map task once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grades
from ..sources.files import INDEX_COLUMNS, nan_to_null
from ..sources.order import ORDINAL

DIMENSIONS = ("x", "y", "z")
DERIVED = ("color_numeric", "clarity_numeric", "cut_gia")


def drop_index_column(df: DataFrame) -> DataFrame:
    present = [c for c in INDEX_COLUMNS if c in df.columns]
    return df.drop(*present) if present else df


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Distinct rows; with a source ordinal, that of each row's first copy."""
    if ORDINAL not in df.columns:
        return df.dropDuplicates()
    names = [c for c in df.columns if c != ORDINAL]
    return df.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.min(ORDINAL).alias(ORDINAL))


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop(how="any")


def drop_invalid_dimensions(df: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Keep rows whose dimensions are all > 0; a no-op unless all exist."""
    if not all(d in df.columns for d in dims):
        return df
    cond = F.lit(True)
    for d in dims:
        cond = cond & (F.col(d) > 0)
    return df.filter(cond)


def add_grade_ordinals(df: DataFrame) -> DataFrame:
    """color -> 1..7, clarity -> 1..8, cut -> lab grade; each only if present."""
    cols = []
    if "color" in df.columns:
        cols.append(grades.color_ordinal("color").alias("color_numeric"))
    if "clarity" in df.columns:
        cols.append(grades.clarity_ordinal("clarity").alias("clarity_numeric"))
    if "cut" in df.columns:
        cols.append(grades.cut_lab_grade("cut").alias("cut_gia"))
    last = [F.col(ORDINAL)] if ORDINAL in df.columns else []
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != ORDINAL], *cols, *last) if cols else df


def clean(df: DataFrame) -> DataFrame:
    """The whole cleaning; returns a new lazy plan, the input is untouched."""
    return (df.transform(drop_index_column)
              .transform(nan_to_null)
              .transform(drop_duplicate_rows)
              .transform(drop_missing)
              .transform(drop_invalid_dimensions)
              .transform(add_grade_ordinals))


def quality_report(df: DataFrame) -> DataFrame:
    """rows, columns (derived included) and missing cells, in one aggregate."""
    missing = F.lit(0).cast("bigint")
    df = df.drop(ORDINAL)
    for name in df.columns:
        missing = missing + F.count_if(F.col(f"`{name}`").isNull())
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns)).alias("columns"),
                  missing.alias("missing_values"))


def natural_order(df: DataFrame) -> list:
    """The source's order where rows have an ordinal; else a total order over
    cleaned rows (they are unique): the input columns, NULLs first."""
    if ORDINAL in df.columns:
        return [F.col(ORDINAL).asc()]
    cols = [c for c in df.columns if c not in DERIVED and not c.startswith("_")]
    return [F.col(f"`{c}`").asc_nulls_first() for c in cols]


def preview(df: DataFrame, n: int = grades.PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows in the order of the file, if they have an ordinal, else
    in the natural order (a top-k, not a global sort)."""
    return df.orderBy(*natural_order(df)).limit(n).drop(ORDINAL)
