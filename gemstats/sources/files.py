"""File sources and sinks: CSV / Parquet / JSON in, CSV / Parquet out.

CSV cells are read as text first so that the usual missing-value tokens
become NULL *before* typing (Spark's CSV reader knows one ``nullValue``
only, and would otherwise type a column holding ``NA`` as string). Types
are then inferred with one aggregate pass, or taken from a given schema,
and applied with ``try_cast`` (a plain cast raises under ANSI mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import ORDINAL, with_ordinal
from .records import has_line_breaks, read_records

# ---------------------------------------------------------------------------
# Cell texts that count as missing, the default token list of
# pandas' CSV reader (which the statistics being mirrored rely on).
# ---------------------------------------------------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Saved-index columns: pandas names a blank header "Unnamed: 0", Spark "_c0".
INDEX_COLUMNS = ("Unnamed: 0", "_c0")
# ---------------------------------------------------------------------------

_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json"}


def format_of(path: str) -> str:
    lower = path.lower().rstrip("/")
    for suffix, fmt in _FORMATS.items():
        if lower.endswith(suffix):
            return fmt
    raise ValueError(f"cannot tell the format of {path!r}; pass fmt= (csv, parquet, json)")


def null_tokens(df: DataFrame, columns: list[str] | None = None,
                tokens: list[str] = NA_TOKENS) -> DataFrame:
    """Turn missing-value tokens in string columns into NULL (no trimming)."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(*[
        F.when(F.col(f"`{n}`").isin(tokens), F.lit(None).cast("string"))
         .otherwise(F.col(f"`{n}`")).alias(n) if n in names else F.col(f"`{n}`")
        for n in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in float/double columns, so one missing value remains."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = F.nanvl(col, F.lit(None).cast(f.dataType))  # names the column once, so plans stay small
        out.append(col.alias(f.name))
    return df.select(*out)


# What pandas' reader takes for a number. A plain cast takes more: '1D' and '2F'
# are 1.0 and 2.0 to it.
INTEGER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def _parsed(name: str, kind: T.DataType) -> Column:
    """The text column as ``kind``; NULL where it isn't one."""
    v = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return v
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.when(v.rlike(NUMBER), F.trim(v).try_cast(kind))
    if isinstance(kind, T.IntegralType):
        return F.when(v.rlike(INTEGER), F.trim(v).try_cast(kind))
    return v.try_cast(kind)


# What a present cell can be, as bits: a column has the type that all of its
# cells' bits allow.
_INT, _DOUBLE, _BOOL, _TEXT = 1, 2, 4, 8
TRUTH = ["True", "TRUE", "true", "False", "FALSE", "false"]


def _kind_sql(tokens: list[str]) -> str:
    """The bit of a cell ``v`` whose digits are cut out in ``rest``, as SQL: plain
    numbers are settled without a regular expression."""
    def quoted(values: list[str]) -> str:
        return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)

    number = f"if(try_cast(trim(v) AS BIGINT) IS NOT NULL AND NOT v RLIKE '[.eE]', {_INT}, {_DOUBLE})"
    return (f"CASE WHEN v IS NULL THEN 0 WHEN rest = '' AND length(trim(v)) BETWEEN 1 AND 18 THEN {_INT}"
            f" WHEN rest = '.' AND length(trim(v)) > 1 THEN {_DOUBLE} WHEN v IN ({quoted(tokens)}) THEN 0"
            f" WHEN v RLIKE r'{NUMBER}' THEN {number} WHEN v IN ({quoted(TRUTH)}) THEN {_BOOL} ELSE {_TEXT} END")


def infer_types(df: DataFrame, tokens: list[str] = NA_TOKENS) -> dict[str, T.DataType]:
    """bigint if every present value parses as an integer, else double if every
    one parses as a number, boolean if every one is a truth value, else string.
    One pass that classifies each cell once (cells as rows, so that the code made
    for it stays small whatever the number of columns); one row a column back."""
    cells = F.posexplode(F.array(*[F.col(f"`{n}`") for n in df.columns])).alias("i", "v")
    kinds = (df.select(cells).selectExpr("i", "v", "translate(trim(v), '0123456789', '') AS rest")
             .selectExpr("i", f"{_kind_sql(tokens)} AS kind").groupBy("i").agg(F.bit_or("kind").alias("kind")))
    bits = {r["i"]: r["kind"] for r in kinds.collect()}  # one row a column
    found = {0: T.LongType(), _INT: T.LongType(), _DOUBLE: T.DoubleType(), _INT | _DOUBLE: T.DoubleType(), _BOOL: T.BooleanType()}
    return {n: found.get(bits.get(i, 0), T.StringType()) for i, n in enumerate(df.columns)}


def parse_columns(df: DataFrame, types: dict[str, T.DataType],
                  tokens: list[str] = NA_TOKENS) -> DataFrame:
    """Text columns -> typed columns: tokens become NULL, and so does a cell that
    isn't of its type (``parse_failures`` counts those)."""
    # no token passes for a number (_parsed), and no number is NaN
    settled = (T.DoubleType, T.FloatType, T.DecimalType, T.IntegralType)
    text = null_tokens(df, [n for n in types if n in df.columns and not isinstance(types[n], settled)], tokens)
    return text.select(*[(_parsed(n, types[n]) if n in types else F.col(f"`{n}`")).alias(n) for n in text.columns])


def parse_failures(df: DataFrame, types: dict[str, T.DataType], tokens: list[str] = NA_TOKENS) -> DataFrame:
    """column, failed, example: the cells of text columns that hold something
    which isn't of its column's type; one row per column of ``types``."""
    text = null_tokens(df, [n for n in types if n in df.columns], tokens)
    own = [n for n in types if n in df.columns]
    bad = {n: F.when(F.col(f"`{n}`").isNotNull() & _parsed(n, types[n]).isNull(), F.col(f"`{n}`")) for n in own}
    one = text.agg(*[F.struct(F.lit(n).alias("column"), F.count(bad[n]).alias("failed"), F.min(bad[n]).alias("example")).alias(f"c{i}")
                     for i, n in enumerate(own)])
    return one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(own))])))


def read_csv_text(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """The cells of a CSV with a header, as text; ``ordered`` adds the rows'
    ordinals in the file. Files split into blocks either way: by Spark's reader
    if each record is a line, else by ``records``."""
    if has_line_breaks(spark, path):
        return read_records(spark, path, ordered)
    # a doubled quote inside a quoted cell is a literal quote (RFC 4180, as pandas reads it)
    rows = (spark.read.option("header", True).option("inferSchema", False)
            .option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").csv(path))
    return with_ordinal(rows, parquet=False) if ordered else rows


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | None = None,
               tokens: list[str] = NA_TOKENS, ordered: bool = False) -> DataFrame:
    """Read a table; the format comes from the file suffix unless ``fmt`` is given.
    ``ordered`` adds the rows' ordinals in the file (``order``)."""
    fmt = fmt or format_of(path)
    if fmt in ("parquet", "json"):
        reader = spark.read if schema is None or fmt == "parquet" else spark.read.schema(schema)
        df = reader.parquet(path) if fmt == "parquet" else reader.json(path)
        df = with_ordinal(df, fmt == "parquet") if ordered else df
        if schema and fmt == "parquet":
            df = df.select(*[f.name for f in schema.fields], *([ORDINAL] if ordered else []))
        return nan_to_null(df)
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r}")
    text = read_csv_text(spark, path, ordered)
    absent = [f.name for f in schema.fields if f.name not in text.columns] if schema else []
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    # columns that the schema doesn't name stay, with inferred types
    given = {f.name: f.dataType for f in schema.fields} if schema else {}
    others = [n for n in text.columns if n not in given and n != ORDINAL]
    found = infer_types(text.select(*[F.col(f"`{n}`") for n in others]), tokens) if others else {}
    types = found | given
    return parse_columns(text, types, tokens)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line and no index column; one file per partition. A
    quote inside a cell is doubled, and spaces stay."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
