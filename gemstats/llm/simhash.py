"""SimHash near-duplicates over pigeonhole blocks.

The 64 fingerprint bits are cut into ``distance + extra`` blocks. Two
fingerprints that differ in at most ``distance`` bits agree on at least
``extra`` whole blocks, so each fingerprint is dealt out once under every
choice of ``extra`` blocks, and pairs that meet are verified by their Hamming
distance. More ``extra`` blocks make longer keys (27 bits by default) and so
smaller meetings, for more rows; the result is the same.

Rows with one fingerprint are one node, whatever their number. Where many
different fingerprints meet under one key, a breadth-first walk over the
vectorised distances emits a spanning forest, never all pairs. A key with
more than ``hot`` fingerprints isn't walked: those fingerprints meet instead
at each point within half the distance of them, which is linear in their
number and just as exact (two words at most 4 bits apart have a point at most
2 bits from both, and all words within 2 bits of a point are within 4 of each
other).

Defined cases: null and wordless texts have fingerprint zero and link like
any other; a text of fewer words than a shingle is one shingle; repeated rows
and null ids each get their row (component_id is null only if every id of the
component is); an empty table gives an empty result. Only doc_id and text are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemstats.llm.common import salted_join, salts_used, small_batches, text_bytes, written
from gemstats.llm.graph import components

BITS = 64
SEED = 42


def shingle_hashes(data: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, joined by single spaces."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[:len(words) - k + 1] - [len(w) + 1 for w in words[:len(words) - k + 1]]).tolist()
    stops = (ends[k - 1:] - 1).tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of n hashes: a bit is 1 if over half have it."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full) == 0:
        return out
    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
    spread = hashes.view(np.uint8).reshape(-1, 8)  # little-endian bytes
    for byte in range(8):
        column = np.ascontiguousarray(spread[:, byte])
        for bit in range(8):
            ones = np.add.reduceat((column >> bit) & 1, starts, dtype=np.int64)
            out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def _fingerprints(k: int, at_once: int = 1 << 20):
    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        out, held, sizes, total = [], [], [], 0

        def flush() -> None:
            nonlocal total
            out.append(majority(np.concatenate(held), np.array(sizes, np.int64)))
            held.clear()
            sizes.clear()
            total = 0

        for t in texts:
            h = shingle_hashes(t.as_py(), k)
            held.append(h)
            sizes.append(len(h))
            total += len(h)
            if total > at_once:
                flush()
        if held:
            flush()
        return pa.array(np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64))

    return simhash


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and mark (hash of id and text)
    for each row."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), _fingerprints(shingle)(text_bytes()).alias("fp"))


def masks(distance: int, extra: int) -> list[int]:
    """A mask (as a signed long) for each choice of ``extra`` blocks."""
    n = distance + extra
    edges = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [(m := sum(c)) - (1 << BITS if m >> (BITS - 1) else 0) for c in combinations(blocks, extra)]


def _walk(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fps (uint64, distinct)."""
    left, found = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            if near.any():
                new = left[near]
                queue.extend(new.tolist())
                found.extend((int(at), int(x)) for x in new)
                left = left[~near]
    return found


def _links(distance: int, short: int = 8):
    """Over rows sorted by key: links among the fingerprints of each key."""

    def of(kind: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])]))
        n = np.diff(np.concatenate([new, [len(key)]]))
        run, a, b = np.repeat(np.arange(len(new)), n), [], []
        few = np.flatnonzero((n <= short)[run])
        for d in range(1, int(min(short, n.max()))):
            i = few[few + d < len(key)]
            i = i[run[i] == run[i + d]]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
            a.append(fp[i])
            b.append(fp[i + d])
        for r in np.flatnonzero(n > short):
            own = fp[new[r]:new[r] + n[r]]
            if pairs := _walk(own, distance):
                i, j = np.array(pairs).T
                a.append(own[i])
                b.append(own[j])
        empty = np.empty(0, np.uint64)
        return np.concatenate([empty, *a]), np.concatenate([empty, *b])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def out(part: list[np.ndarray]) -> pa.RecordBatch:
            a, b = of(part[0], part[1], part[2].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) if len(cols[0]) else np.empty(0, bool)
            cut = int(np.argmax(last)) if len(last) else 0
            if cut:
                yield out([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if len(held[0]):
            yield out(held)

    return links


def _through_points(hot: DataFrame, distance: int) -> DataFrame:
    """Links among the fingerprints of hot keys, through the points within
    half the distance of each (an even distance)."""
    half = distance // 2
    flips = [sum(1 << b for b in c) for r in range(half + 1) for c in combinations(range(BITS), r)]
    array = F.lit([f - (1 << BITS) if f >> (BITS - 1) else f for f in flips])
    points = hot.select("fp", F.explode(array).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).filter("m < x")
    return points.join(least, "point").filter("fp != m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def fingerprint_links(fps: DataFrame, distance: int = 4, extra: int = 3, hot: int = 100_000) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``distance`` bits;
    ``fps`` has distinct, non-null ``fp``."""
    if distance % 2:
        raise ValueError("an even distance is needed for keys with many fingerprints")
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                      for i, m in enumerate(masks(distance, extra))])
    dealt = fps.select("fp", F.explode(kinds).alias("k")).select("k.kind", "k.key", "fp")
    big = written(dealt.groupBy("kind", "key").count().filter(F.col("count") > hot).select("kind", "key"), "hot")
    found = []
    if not big.isEmpty():  # each hot key has over ``hot`` fingerprints, so their number is small against the rows
        found.append(_through_points(salted_join(dealt, big, ["kind", "key"], F.col("fp")).select("fp").distinct(), distance))
        dealt = dealt.join(big, ["kind", "key"], "left_anti")
    found.append(dealt.repartition("kind", "key").sortWithinPartitions("kind", "key", "fp")
                 .mapInArrow(_links(distance), "a bigint, b bigint"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def simhash_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, extra: int = 3, hot: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable through links), fp, root (the
    component's smallest fingerprint, as a long) and mark."""
    rows = written(fingerprints(docs, shingle), "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), salts_used(F.xxhash64("doc_id"), 8)), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), distance, extra, hot))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("__salts").alias("rows_salts"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), salts_used(F.col("fp"), 8))
    named = salted_join(rooted, smallest, ["root"], F.col("fp"), 8).select("fp", "root", "component_id", F.col("rows_salts").alias("__salts"))
    out = salted_join(rows, named, ["fp"], F.xxhash64("doc_id"), 8)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "root", "mark")


def simhash_dedup(docs: DataFrame, **params) -> DataFrame:
    """Of each component the row with the smallest doc_id (null ids last; of
    rows that share it, the one with the smallest hash), with all columns."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first")
    keep = simhash_groups(docs, **params).groupBy("root").agg(first).select(F.col("first.mark").alias("__kept"))
    return (docs.withColumn("__mark", F.xxhash64("doc_id", "text"))
            .join(keep, F.col("__mark") == F.col("__kept"), "left_semi")
            .dropDuplicates(["__mark"]).drop("__mark"))
