"""What the operators share: reading, bytes of a text, hash folds, written
intermediates and a join that splits hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gemstats.session import shared_dir

#: Characters that separate words: space, tab, LF, VT, FF, CR. ``bytes.split()``
#: and ``bytes.lower()`` work on exactly these and on A-Z.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Bounds an Arrow batch by bytes, so that very long texts don't pile up
    in a Python worker; a smaller bound the user set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > size:
        spark.conf.set(key, str(size))


def text_bytes(text: str | Column = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text, F.lit("")).cast("binary")


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k; a null id falls in fold 0."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % k, F.lit(0))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one written intermediate, in the shared folder."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the folder of a table that ``written`` made and no plan needs."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def among(df: DataFrame, ids: DataFrame, how: str, key: str = "id", small: int = 1_000_000) -> DataFrame:
    """df with (left_semi) or without (left_anti) these ids; they are broadcast
    only if there are few, and df's rows then stay where they are."""
    return df.join(F.broadcast(ids) if ids.count() <= small else ids, key, how)


def _salt(spread: Column, salts: int) -> Column:
    return F.pmod(F.hash(spread), F.lit(salts))


def salts_used(spread: Column, salts: int = 16) -> Column:
    """An aggregate over the left rows of a key: the salts they have, as bits
    (column ``__salts``), so that a salted join repeats a key's right row
    only for those; a key of one row then has one copy."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), _salt(spread, salts))).alias("__salts")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column,
                salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose left rows of one key are spread over ``salts`` tasks by
    ``spread``; the right side (one row for a key) is repeated for each salt,
    or for those in its ``__salts``. Key columns must not be null."""
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if "__salts" in right.columns:
        every = F.filter(every, lambda s: F.call_function("shiftright", F.col("__salts"), s).bitwiseAND(F.lit(1)) == 1)
    copies = right.withColumn("__salt", F.explode(every)).drop("__salts")
    return left.withColumn("__salt", _salt(spread, salts)).join(copies, [*keys, "__salt"], how).drop("__salt")
