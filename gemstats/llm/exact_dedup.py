"""Exact de-duplication by composable polynomial fingerprints.

Texts count as equal when they are identical after deleting every character
of ``[\\x20\\x09-\\x0D]``. The fingerprint of normalised bytes b0 b1 ... is
``sum(b_i * B**i) mod p`` for two primes below 2**31. It composes:
``F(xy) = F(x) + B**len(x) * F(y)``, so pieces of a huge document are hashed
in parallel and added up after shifting by the length before them. Rows with
the same length and fingerprints are then compared chunk by chunk in a sorted
stream; texts that differ despite equal fingerprints become classes of their
own.

Defined cases: a null text is empty; all empty texts are one class; of rows
that tie in length and doc_id, one stays; null ids rank after all others; an
empty table gives an empty result. Only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemstats.llm.common import remove, salted_join, salts_used, small_batches, text_bytes, written

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 48271)
SPACES = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 16
KEY = ["n_bytes", "f1", "f2", "generation"]


@lru_cache(maxsize=8)
def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**i mod prime for i < n."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += step
    return out


def combine(left: int, n_left: int, right: int, base: int, prime: int) -> int:
    """The fingerprint of a concatenation from those of its parts."""
    return (left + pow(base, n_left, prime) * right) % prime


def fingerprint(data: bytes, base: int, prime: int, chunk: int = CHUNK) -> int:
    """Chunks are hashed one by one and combined from the back."""
    total = 0
    for at in reversed(range(0, len(data), chunk)):
        part = np.frombuffer(data, np.uint8, min(chunk, len(data) - at), at).astype(np.uint64)
        own = int((part * powers(base, prime, chunk)[:len(part)]).sum() % np.uint64(prime))
        total = combine(own, len(part), total, base, prime)
    return total


def _hashed(primes: tuple[int, int], with_sha: bool):
    kind = "struct<n_bytes:bigint,f1:bigint,f2:bigint,sha:string>"

    @F.arrow_udf(kind)
    def hashed(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            data = t.as_py().translate(None, SPACES)
            f1, f2 = (fingerprint(data, b, p) for b, p in zip(BASES, primes, strict=True))
            sha = hashlib.sha256(data).hexdigest() if with_sha else ""
            rows.append((len(data), f1, f2, sha))
        n, f1, f2, sha = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
             pa.array(sha, pa.string())], names=["n_bytes", "f1", "f2", "sha"])

    return hashed


def _shifted(primes: tuple[int, int]):
    @F.arrow_udf("struct<f1:bigint,f2:bigint>")
    def shifted(before: pa.Array, f1: pa.Array, f2: pa.Array) -> pa.Array:
        cols = [[pow(b, n, p) * f % p for n, f in zip(before.to_pylist(), part.to_pylist(), strict=True)]
                for b, p, part in zip(BASES, primes, (f1, f2), strict=True)]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["f1", "f2"])

    return shifted


def fingerprints(docs: DataFrame, huge_bytes: int = 1 << 24, piece_bytes: int = 1 << 22,
                 primes: tuple[int, int] = PRIMES) -> DataFrame:
    """doc_id, mark (hash of id and text), n_points, n_bytes, f1, f2, sha for
    each row. Texts over ``huge_bytes`` are cut into pieces that are dealt out
    to all tasks and combined."""
    rows = docs.select("doc_id", text_bytes().alias("data"),
                       F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"),
                       F.xxhash64("doc_id", "text").alias("mark"))
    small = rows.filter(F.octet_length("data") <= huge_bytes)
    out = (small.withColumn("h", _hashed(primes, True)("data"))
           .select("doc_id", "mark", "n_points", "h.n_bytes", "h.f1", "h.f2", "h.sha"))
    huge = rows.filter(F.octet_length("data") > huge_bytes)
    pieces = (huge.select("doc_id", "mark", "n_points", "data",
                          F.expr(f"explode(sequence(0, cast((octet_length(data) - 1) / {piece_bytes} as int)))").alias("k"))
              .select("mark", "doc_id", "k", F.expr(f"substring(data, k * {piece_bytes} + 1, {piece_bytes})").alias("data"))
              .repartition(F.col("mark"), F.col("k"))
              .withColumn("h", _hashed(primes, False)("data"))
              .select("mark", "doc_id", "k", "h.n_bytes", "h.f1", "h.f2")
              # a repeated row gives the same pieces again
              .groupBy("mark", "doc_id", "k").agg(*[F.first(c).alias(c) for c in ("n_bytes", "f1", "f2")]))
    before = F.expr("coalesce(sum(n_bytes) over (partition by mark, doc_id order by k "
                    "rows between unbounded preceding and 1 preceding), 0)")
    sums = (pieces.withColumn("before", before)
            .withColumn("h", _shifted(primes)("before", "f1", "f2"))
            .groupBy("mark", "doc_id")
            .agg(F.sum("n_bytes").alias("n_bytes"),
                 F.pmod(F.sum("h.f1"), F.lit(primes[0])).alias("f1"),
                 F.pmod(F.sum("h.f2"), F.lit(primes[1])).alias("f2")))
    ids = huge.select("doc_id", "mark", "n_points",
                      F.sha2(F.regexp_replace(F.col("data").cast("string"), r"[\x20\x09-\x0D]+", ""), 256).alias("sha"))
    whole = (ids.alias("i").join(sums.alias("s"), F.expr("i.mark = s.mark and i.doc_id <=> s.doc_id"))
             .select("i.doc_id", "i.mark", "i.n_points", "s.n_bytes", "s.f1", "s.f2", "i.sha"))
    return out.unionByName(whole)


def _mismatches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over chunks sorted by class and place, the class's first row in front:
    the marks of rows whose chunk differs from it. Holds one chunk."""
    at, first = None, b""
    for batch in batches:
        found = []
        keys = list(zip(*(batch.column(c).to_pylist() for c in [*KEY, "salt", "k"]), strict=True))
        marks = batch.column("mark")
        for i, (key, data) in enumerate(zip(keys, batch.column("data"), strict=True)):
            data = data.as_buffer()
            if key != at:
                at, first = key, data.to_pybytes()
            elif not data.equals(pa.py_buffer(first)):
                found.append(i)
        yield pa.RecordBatch.from_arrays([marks.take(pa.array(found, pa.int64()))], names=["mark"])


def _compare(docs: DataFrame, rows: DataFrame, per_task: int, chunk: int) -> DataFrame:
    """Marks of rows that differ from the first row of their class. ``rows``
    has KEY and mark; a class of many rows is dealt to several streams, each
    of which gets the first row too."""
    classes = (rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("mark").alias("head"), salts_used(F.col("mark")))
               .filter("n > 1").withColumn("streams", F.ceil(F.col("n") / per_task).cast("int")))
    members = (salted_join(rows, classes, KEY, F.col("mark")).select(*KEY, "mark", "head", "streams").distinct())
    texts = docs.select(F.xxhash64("doc_id", "text").alias("mark"), text_bytes().alias("data"))
    held = members.join(texts, "mark")
    strip = F.arrow_udf(lambda t: pa.array([x.as_py().translate(None, SPACES) for x in t], pa.binary()), "binary")
    dealt = (held.withColumn("salt", F.expr("explode(if(mark = head, sequence(0, streams - 1), "
                                            "array(pmod(hash(mark), streams))))"))
             .withColumn("data", strip("data"))
             .withColumn("k", F.expr(f"explode(sequence(0, cast(octet_length(data) / {chunk} as int)))"))
             .withColumn("data", F.expr(f"substring(data, k * {chunk} + 1, {chunk})"))
             .withColumn("behind", F.col("mark") != F.col("head")))
    place = [*KEY, "salt", "k"]
    return (dealt.select(*place, "behind", "mark", "data").repartition(*place)
            .sortWithinPartitions(*place, "behind")
            .mapInArrow(_mismatches, "mark bigint").distinct())


def exact_groups(docs: DataFrame, huge_bytes: int = 1 << 24, piece_bytes: int = 1 << 22,
                 primes: tuple[int, int] = PRIMES, per_task: int = 64, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256,
    mark (xxhash64 of doc_id and text). Of equal texts the one with the most
    code points, then the smallest doc_id stays.

    ``per_task`` is how many copies one comparing stream gets; ``primes`` may
    be small in tests, to force equal fingerprints of different texts."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    state = written(fingerprints(docs, huge_bytes, piece_bytes, primes)
                    .withColumn("row", F.monotonically_increasing_id())
                    .withColumn("generation", F.lit(0)), "fingerprints")
    generation, open_rows = 0, state
    while True:  # a second turn only if different texts have equal fingerprints
        apart = written(_compare(docs, open_rows.select(*KEY, "mark"), per_task, chunk), "apart")
        if apart.isEmpty():
            break
        generation += 1
        previous = state
        state = written(state.join(apart.withColumn("__apart", F.lit(1)), "mark", "left")
                        .withColumn("generation", F.expr(f"if(__apart = 1, {generation}, generation)").cast("int"))
                        .drop("__apart").select(*state.columns), "fingerprints")
        remove(previous)
        remove(apart)
        open_rows = state.filter(F.col("generation") == generation)
    first = F.expr("max_by(struct(doc_id, row), struct(n_points, doc_id is not null, ~doc_id, -row))")
    classes = state.groupBy(*KEY).agg(F.count("*").alias("group_size"), first.alias("first"), salts_used(F.col("row")))
    joined = salted_join(state, classes, KEY, F.col("row"))
    return joined.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
                         (F.col("row") == F.col("first.row")).alias("kept"),
                         F.col("sha").alias("text_sha256"), "mark")


def exact_dedup(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = exact_groups(docs, **params).filter("kept").select(F.col("mark").alias("__kept"))
    return (docs.withColumn("__mark", F.xxhash64("doc_id", "text"))
            .join(kept, F.col("__mark") == F.col("__kept"), "left_semi")
            .dropDuplicates(["__mark"]).drop("__mark"))
