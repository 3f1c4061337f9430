"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles has a signature of 60 min-hashes of 8 bits.
Signatures are cut into 10 chunks of 6 symbols. Two signatures that differ in
fewer than 20 symbols have a chunk that differs in at most one (pigeonhole), so
each chunk is enumerated with each of its symbols left out, and all pairs under
that signature distance meet under such a key (as do nearly all that are further
apart: of sets with a similarity of 0.85, all but 3 in 10 million). Links are
confirmed on the full sets, which are made again from the whole texts.

Equal sets are one node, whatever their number. In each meeting the nodes are
compared with one centre first, the one with the most meetings (an original,
rather than one of its edited copies). That is linear in the rows. Meetings whose
nodes are in several components after that are compared by blocks of 512 (no
task holds a meeting): first a forest of the likely pairs that would connect
components is confirmed, then, where meetings are still mixed, all of the likely
pairs of different components. So a link can be left unconfirmed only between
nodes that are connected anyway. A pair is likely if its signatures differ in at
most 24 symbols (sets of similarity 0.85 do so but for one pair in a million),
and its odd sketches and sizes allow a link: a shingle that only one of two sets
has turns one of 2048 bits, so the sketches differ in no more bits than the sets
in shingles. That bound loses nothing, and leaves few pairs that fail: without
it, groups of copies just below the limit would be confirmed pair by pair.

Defined cases: A text of fewer words than a shingle is one shingle; null, empty
and wordless texts have an empty set, are linked with nothing and are kept;
repeated rows each get their row; null ids are never the smallest of a component
(component_id is null only if all of its ids are); an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemstats.llm.common import among, remove, salted_join, salts_used, small_batches, text_bytes, written
from gemstats.llm.graph import components
from gemstats.llm.simhash import shingle_hashes

SYMBOLS, CHUNK = 60, 6
#: Bits of a set's odd sketch.
ODD = 2048
WIDTH = SYMBOLS + ODD // 8
SHINGLE, PERCENT = 5, 85
#: Pairs whose signatures differ in more symbols aren't confirmed.
MOST_APART = 24
BLOCK = 512

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 2**63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, SYMBOLS, np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BIT = np.uint64(0xD6E8FEB86659FD93)


def mixed(values: np.ndarray, factor: np.uint64) -> np.ndarray:
    """A 64-bit mix of 64-bit values."""
    v = values * factor
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(32))


def signatures(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of SYMBOLS bytes for each run of n distinct hashes (zero for none)."""
    out = np.zeros((len(n), SYMBOLS), np.uint8)
    full = np.flatnonzero(n)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((hashes ^ _SHIFTS[k]) * _FACTORS[k], starts)
            out[full, k] = mixed(least, _MIX[0]) >> np.uint64(56)
    return out


def odd_sketches(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of ODD bits for each run of n distinct hashes: the parity of how
    many of them fall on each bit."""
    bit = (mixed(hashes, _BIT) >> np.uint64(64 - ODD.bit_length() + 1)).astype(np.int64)
    count = np.bincount(np.repeat(np.arange(len(n)) * ODD, n) + bit, minlength=len(n) * ODD)
    return np.packbits((count & 1).astype(np.uint8).reshape(-1, ODD), axis=1)


def likely(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of signature and sketch, of sets of a and b shingles, can be
    ``percent`` alike: they differ in at most (100 - p)(a + b) / (100 + p)."""
    good = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    x, y = np.broadcast_to(x, (len(good), WIDTH))[good], np.broadcast_to(y, (len(good), WIDTH))[good]
    near = (x[:, :SYMBOLS] != y[:, :SYMBOLS]).sum(1) <= MOST_APART
    x, y, total = x[near, SYMBOLS:], y[near, SYMBOLS:], (np.zeros(len(good), np.int64) + a + b)[good][near]
    apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    good[good] = near
    good[good] = (100 + percent) * apart <= (100 - percent) * total
    return good


_FACTS = "row bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint, signature binary, text binary"


def _facts(k: int, at_once: int = 1 << 18):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column("text"), 0
            sets: list[np.ndarray] = []
            for i in range(batch.num_rows):
                sets.append(np.unique(shingle_hashes(texts[i].as_py(), k)))
                if sum(map(len, sets[-64:])) > at_once or len(sets) >= 1024 or i == batch.num_rows - 1:
                    yield out(batch.slice(start, len(sets)), sets)
                    start, sets = i + 1, []

    def out(rows: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        full, sums = np.flatnonzero(n), []
        for factor in _MIX:
            total = np.zeros(len(n), np.uint64)
            if len(full):
                total[full] = np.add.reduceat(mixed(every, factor), np.concatenate([[0], np.cumsum(n[full])[:-1]]))
            sums.append(pa.array(total.view(np.int64)))
        signs = np.concatenate([signatures(every, n), odd_sketches(every, n)], axis=1)
        return pa.RecordBatch.from_arrays(
            [rows.column("row"), rows.column("doc_id"), pa.array(n), *sums, pa.array([s.tobytes() for s in signs], pa.binary()), rows.column("text")],
            names=["row", "doc_id", "n", "s1", "s2", "signature", "text"])

    return facts


def likely_column(percent: int) -> Column:
    """Whether a pair's a_signature, b_signature, a_n and b_n allow a link."""

    @F.arrow_udf("boolean")
    def of(x: pa.Array, y: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, WIDTH) for v in (x, y))
        return pa.array(likely(x, y, a.to_numpy(), b.to_numpy(), percent))

    return of("a_signature", "b_signature", "a_n", "b_n")


def keys(nodes: DataFrame) -> DataFrame:
    """key, node: each chunk of the signature with one symbol left out."""
    chunk = f"substring(signature, {CHUNK} * (k div {CHUNK}) + 1, {CHUNK})"
    return (nodes.selectExpr("node", "signature", f"explode(sequence(0, {SYMBOLS - 1})) as k")
            .selectExpr(f"xxhash64(k, overlay({chunk} placing X'00' from cast(k % {CHUNK} as int) + 1 for 1)) as key", "node"))


def _same(percent: int, k: int):
    """Over rows sorted by (a, part), the text of ``a`` first: the pairs whose
    sets are alike enough."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, text in zip(batch.column("a"), batch.column("b"), batch.column("text"), strict=True):
                theirs = np.unique(shingle_hashes(text.as_py(), k))
                if not b.is_valid:
                    own = theirs
                    continue
                small, large = (own, theirs) if len(own) < len(theirs) else (theirs, own)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0
                if 100 * both >= percent * (len(own) + len(theirs) - both):
                    found.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return same


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, at_once: int = 128) -> DataFrame:
    """Those of the written ``pairs(a, b)`` whose sets have 100 * intersection
    >= percent * union. The pairs of one ``a`` are dealt to a task for every
    ``at_once`` of them; only texts of pairs are moved, if the pairs' nodes are few
    enough to be broadcast."""
    texts = among(texts, written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "paired"), "left_semi", "node")
    counted = pairs.groupBy("a").agg(F.count("*").alias("n"), salts_used(F.col("b")))
    dealt = (salted_join(pairs, counted, ["a"], F.col("b"))
             .withColumn("part", F.expr(f"pmod(xxhash64(b), cast(ceil(n / {at_once}) as bigint))")).select("a", "b", "part"))
    other = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    own = (dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a")
           .select("a", "part", F.lit(None).cast("bigint").alias("b"), "text"))
    return (own.unionByName(other).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
            .mapInArrow(_same(percent, shingle), "a bigint, b bigint"))


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose set sizes and signatures allow a link."""
    pairs = written(pairs.distinct(), "pairs")
    own = nodes.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("signature").alias("a_signature"))
    own = pairs.groupBy("a").agg(salts_used(F.col("b"))).join(own, "a")
    other = nodes.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("signature").alias("b_signature"))
    both = salted_join(pairs, own, ["a"], F.col("b")).join(other, "b")
    return both.filter(likely_column(percent)).select("a", "b")


def _labelled(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Of the meetings with several components: key, node, score, root, centre_root."""
    rooted = hits.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_keys = (rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), salts_used(F.col("node")))
                  .filter("low != high").select("key", "size", "__salts"))
    return salted_join(rooted.drop("size"), mixed_keys, ["key"], F.col("node"))


def _stars(hits: DataFrame) -> DataFrame:
    """Pairs (a, b) of each key's centre, the node with the highest score, and
    its other nodes."""
    centres = hits.groupBy("key").agg(F.max(F.struct("score", "node")).alias("best"), salts_used(F.col("node")))
    met = salted_join(hits, centres.select("key", F.col("best.node").alias("a"), "__salts"), ["key"], F.col("node"))
    return met.filter("a != node").select("a", F.col("node").alias("b"))


def _across(percent: int, forest: bool):
    """Over rows sorted by tile (key, i, j): the likely pairs of different
    components, or a forest of them that connects what all of them connect."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key, i, j, block, node, root, n = (rows.column(c).to_numpy() for c in ("key", "i", "j", "block", "node", "root", "n"))
            signs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, WIDTH)
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
                own = root[lo:hi].copy()  # components, joined as the forest grows
                for x in range(lo, hi):
                    at = np.flatnonzero(own[x - lo + 1:] != own[x - lo]) + x + 1
                    if i[lo] != j[lo]:
                        at = at[block[at] != block[x]]
                    at = at[likely(signs[at], signs[x], n[at], n[x], percent)]
                    if forest and len(at):
                        at = at[np.unique(own[at - lo], return_index=True)[1]]
                        own[np.isin(own, own[at - lo])] = own[x - lo]
                    a.append(np.minimum(node[at], node[x]))
                    b.append(np.maximum(node[at], node[x]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])])
            key, i, j = (held.column(c).to_numpy() for c in ("key", "i", "j"))
            last = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
            cut = int(np.argmax(last))
            if cut:
                yield from out(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from out(held)

    return across


def _likely_across(hits: DataFrame, nodes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Likely pairs of different components in the meetings, by pairs of blocks."""
    n_blocks = f"cast(ceil(size / {BLOCK}) as int)"
    dealt = (hits.selectExpr("key", "node", "root", f"cast(pmod(xxhash64(node), {n_blocks}) as int) as block", f"explode(sequence(0, {n_blocks} - 1)) as o")
             .selectExpr("key", "node", "root", "block", "least(block, o) as i", "greatest(block, o) as j"))
    return (dealt.join(nodes, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
            .mapInArrow(_across(percent, forest), "a bigint, b bigint").distinct())


def set_links(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) that connect all nodes that links connect, and
    node, root of their components; ``nodes(node, n, signature)`` and
    ``texts(node, text)`` are written tables of distinct sets."""
    dealt = keys(nodes)
    shared = dealt.groupBy("key").agg(F.count("*").alias("size"), salts_used(F.col("node"))).filter("size > 1")
    hits = written(salted_join(dealt, shared, ["key"], F.col("node")), "hits")
    scores = hits.groupBy("node").agg(F.sum("size").alias("score"))
    hits = hits.join(scores, "node")
    tested = written(_likely(_stars(hits), nodes, percent), "likely")
    links = written(confirmed(tested, texts, shingle, percent), "links")
    labels = components(links)
    for forest in (True, False):
        open_hits = written(_labelled(hits, labels), "open")
        new = written(_likely_across(open_hits, nodes, percent, forest), "across")
        if new.isEmpty():  # no likely pair of different components is left
            break
        new = written(new.join(tested, ["a", "b"], "left_anti").join(tested.selectExpr("a as b", "b as a"), ["a", "b"], "left_anti"), "likely")
        tested = tested.unionByName(new)
        links = links.unionByName(written(confirmed(new, texts, shingle, percent), "links"))
        labels = components(links)
        remove(open_hits)
    return links, labels


def minhash_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable through links), kept (whether that is its own)."""
    small_batches(docs.sparkSession)
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_bytes().alias("text"))
    rows = written(source.mapInArrow(_facts(shingle), _FACTS), "sets")
    sets = written(rows.filter("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), salts_used(F.col("row"))), "distinct")
    heads = rows.join(sets.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = written(heads.select(F.col("row").alias("node"), "n", "signature"), "nodes")
    _, labels = set_links(nodes, rows.select(F.col("row").alias("node"), "text"), shingle, percent)
    rooted = sets.join(labels, "node", "left").select("s1", "s2", "least", F.coalesce("root", "node").alias("root"), F.col("__salts").alias("rows_salts"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), salts_used(F.xxhash64("s1")))
    named = salted_join(rooted, smallest, ["root"], F.xxhash64("s1")).select("s1", "s2", "component_id", F.col("rows_salts").alias("__salts"))
    plain = rows.select("row", "doc_id", "n", "s1", "s2")
    out = salted_join(plain.filter("n > 0"), named, ["s1", "s2"], F.col("row")).unionByName(
        plain.filter("n = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
