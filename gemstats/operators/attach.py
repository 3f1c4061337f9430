"""Small side tables whose size is known before they are broadcast."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

MAX_BROADCAST_ROWS = 100_000
SALTS = 32


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its row count is then known
    from the file footers, and later branches read it instead of its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gemstats/side-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, small: DataFrame, keys: list[str], max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined to the one row per key of ``small``. The side table is
    written first; if it has at most ``max_rows`` rows it is broadcast, so the
    rows don't move; otherwise the rows of one key are spread over several
    tasks. Rows are never dealt out by the key alone."""
    side = written(small)
    if side.count() <= max_rows:
        return rows.join(F.broadcast(side), keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")
