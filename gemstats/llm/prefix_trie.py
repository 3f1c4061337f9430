"""Prefix trie of conversations by whole-sequence collapse.

Every conversation is rebuilt from the head of its batch and its own turns.
A conversation's first d turns have a fingerprint that adds up: the sum, over
their places, of a 130-bit hash of place, role and text (five sums of 26 bits,
so that no sum overflows below 2^37 turns). So prefixes are fingerprinted by
running sums, and conversations that are equal as a whole have equal last sums.
Equal conversations collapse into one weighted sequence with a list of ends and
its smallest member; a sequence that is a proper prefix of another is dropped
from the leaves by an anti-join; what is left to do for a trie is to add up the
weighted prefixes of the distinct sequences.

A node belongs to the sequence of its smallest member, which owns the nodes
from some depth down to its end. With that, the tokens saved in a subtree are
the words below the node in all its members, less those of the distinct nodes,
both of which are sums over the sequences through the node.

Running sums need no conversation in one task: turns are dealt out by range of
(conversation, turn), summed within (range, conversation), and the few
conversations that go over a range's edge (one an edge) get the sums of the
ranges before. Keys with many rows are summed in the map tasks first. The ids of
the ends are sorted by range, joined into strings of bounded length, and only
these strings, one after another, pass through the digest of their node.

Defined cases: null role and text are empty; turns are ordered with null first,
equal turns by the MD5 digest of role and text; a repeated row is a turn of its
own; rows without conv_id belong to no conversation; a batch whose first
conversation is absent has no head; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemstats.llm.common import salted_join, salts_used, written
from gemstats.llm.mixing import words_of

#: Conversations of a batch, and the number of heads' lengths (0, 1, 2, 3).
BATCH, HEADS = 20, 4
SUMS = [f"s{i}" for i in range(5)]
HASH = [f"x{i}" for i in range(5)]
NODE = ["depth", "a", "b"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (16 bytes of role and text) and words of each row
    that belongs to a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), words_of().alias("words"))


def _hashes(place: str) -> list[str]:
    """The five parts of the hash of a turn at a place."""
    one, two = f"xxhash64({place}, digest)", f"xxhash64(digest, {place}, 1)"
    bits = "67108863"  # 26 ones
    return [f"{one} & {bits} as x0", f"shiftrightunsigned({one}, 26) & {bits} as x1", f"{two} & {bits} as x2",
            f"shiftrightunsigned({two}, 26) & {bits} as x3",
            f"shiftrightunsigned({one}, 52) + shiftleft(shiftrightunsigned({two}, 52), 12) as x4"]


def _key(depth: str, sums: list[str], names: tuple[str, str] = ("a", "b")) -> list[str]:
    """Two hashes of a prefix's depth and sums."""
    return [f"xxhash64(cast({depth} as bigint), {', '.join(sums)}) as {names[0]}",
            f"xxhash64({', '.join(reversed(sums))}, cast({depth} as bigint), 7) as {names[1]}"]


def _numbered(ranged: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with pos, their place in the conversation from 0; ``places`` has
    ``before``, the rows in earlier ranges, of each (part, conv_id)."""
    return ranged.join(places, ["part", "conv_id"]).withColumn("pos", F.expr(
        "before - 1 + row_number() over (partition by part, conv_id order by turn asc nulls first, digest, id)"))


def _heads(ranged: DataFrame, places: DataFrame) -> DataFrame:
    """batch, turns: the first turns of each batch's first conversation, with
    the sums, the words so far and the words of each."""
    first = f"conv_id % {BATCH} = 0"
    rows = _numbered(ranged.filter(first), places.filter(first)).filter(f"pos < {HEADS - 1}").selectExpr("conv_id", "pos", "words", *_hashes("pos"))
    over = "over (partition by conv_id order by pos)"
    added = rows.selectExpr("conv_id", "pos", "words", f"sum(words) {over} as upto", *[f"sum({x}) {over} as {s}" for x, s in zip(HASH, SUMS, strict=True)])
    return (added.groupBy(F.col("conv_id").alias("batch"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "words", "upto", *SUMS))).alias("turns")))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: the conversations (conv_id, head, k, and the sums
    and words of the head), their own turns below the head (part, conv_id,
    depth, words, hashes, sums, upto), and the (part, conv_id) of all rows."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(turns(conversations), "turns")
    ranged = written(rows.withColumn("id", F.monotonically_increasing_id())
                     .repartitionByRange(parts, "conv_id", F.asc_nulls_first("turn"), "digest", "id")
                     .withColumn("part", F.spark_partition_id()), "turns-by-range")
    places = written(ranged.groupBy("part", "conv_id").agg(F.count("*").alias("n")).selectExpr(
        "part", "conv_id", "sum(n) over (partition by conv_id order by part) - n as before",
        "count(*) over (partition by conv_id) as ranges"), "places")
    convs = places.filter("before = 0").selectExpr(
        "conv_id", f"conv_id - conv_id % {BATCH} as batch", f"cast(crc32(cast(cast(conv_id as string) as binary)) % {HEADS} as int) as h")
    none = "cast(array() as array<struct<pos:bigint,words:bigint,upto:bigint,s0:bigint,s1:bigint,s2:bigint,s3:bigint,s4:bigint>>)"
    convs = (convs.join(_heads(ranged, places), "batch", "left")
             .selectExpr("conv_id", "h", f"if(h = 0 or turns is null, {none}, slice(turns, 1, greatest(h, 1))) as head")
             .selectExpr("conv_id", "h", "head", "size(head) as k", "coalesce(try_element_at(head, -1).upto, 0L) as head_words",
                         *[f"coalesce(try_element_at(head, -1).{s}, 0L) as head_{s}" for s in SUMS]))
    convs = written(convs, "conversations")
    held = [f"head_{s}" for s in SUMS]
    side = places.join(convs.select("conv_id", "h", "k", "head_words", *held), "conv_id")
    own = (_numbered(ranged, side).filter("pos >= h").withColumn("depth", F.expr("pos - h + k + 1"))
           .selectExpr("part", "conv_id", "depth", "words", "head_words", *held, *_hashes("depth - 1")))
    over = "over (partition by part, conv_id order by depth)"
    run = written(own.selectExpr("part", "conv_id", "depth", "words", *HASH, f"head_words + sum(words) {over} as upto",
                                 *[f"head_{s} + sum({x}) {over} as {s}" for x, s in zip(HASH, SUMS, strict=True)]), "sums")
    # conversations in several ranges: at most one goes over each edge, so twice as many rows as ranges
    wide = F.broadcast(places.filter("ranges > 1").select("part", "conv_id"))
    totals = run.join(wide, ["part", "conv_id"]).groupBy("part", "conv_id").agg(F.sum("words").alias("words"), *[F.sum(x).alias(x) for x in HASH])
    over = "over (partition by conv_id order by part)"
    earlier = totals.selectExpr("part", "conv_id", f"sum(words) {over} - words as more", *[f"sum({x}) {over} - {x} as more_{x}" for x in HASH])
    run = (run.join(F.broadcast(earlier), ["part", "conv_id"], "left")
           .selectExpr("part", "conv_id", "depth", "words", *HASH, "upto + coalesce(more, 0) as upto",
                       *[f"{s} + coalesce(more_{x}, 0) as {s}" for x, s in zip(HASH, SUMS, strict=True)]))
    return convs, run, places.select("part", "conv_id")


def _pieces(at_most: int = 1 << 16):
    """Over rows sorted by node and conv_id: the ids of a node, joined by
    commas, in strings of at most so many."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        done: list[list] = [[], [], [], [], []]

        def close() -> None:
            if ids:
                for c, v in zip(done, (*node, ids[0], ",".join(map(str, ids))), strict=True):
                    c.append(v)
                ids.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(done)],
                                               names=[*NODE, "first", "ids"])
            for c in done:
                c.clear()
            return batch

        for batch in batches:
            for *at, conv_id in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
                if at != node or len(ids) >= at_most:
                    close()
                    node = at
                ids.append(conv_id)
            yield out()
        close()
        yield out()

    return pieces


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over strings sorted by node and first id: the SHA-256 of each node's."""
    node, sha, done = None, hashlib.sha256(), [[], [], [], []]

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(done)], names=[*NODE, "ends_sha256"])
        for c in done:
            c.clear()
        return batch

    def close() -> None:
        if node is not None:
            for c, v in zip(done, (*node, sha.hexdigest()), strict=True):
                c.append(v)

    for batch in batches:
        for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if at == node:
                sha.update(b",")
            else:
                close()
                node, sha = at, hashlib.sha256()
            sha.update(ids.encode())
        yield out()
    close()
    yield out()


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: for each node at which conversations end, the
    digest of their ids in order."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "depth bigint, a bigint, b bigint"
    pieces = (ends.repartitionByRange(parts, "a", "b", "depth", "conv_id").sortWithinPartitions("a", "b", "depth", "conv_id")
              .mapInArrow(_pieces(), f"{kind}, first bigint, ids string"))
    return (pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
            .mapInArrow(_digests, f"{kind}, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    convs, run, places = rebuilt(conversations)
    own = run.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("words").alias("words"), *[F.sum(x).alias(x) for x in HASH])
    ends = (convs.join(own, "conv_id", "left")
            .selectExpr("conv_id", "k + coalesce(n, 0) as depth", "head_words + coalesce(words, 0) as all_words",
                        *[f"head_{s} + coalesce({x}, 0) as {s}" for x, s in zip(HASH, SUMS, strict=True)]))
    ends = written(ends.selectExpr("conv_id", "depth", "all_words", *_key("depth", SUMS)), "ends")
    # whole sequences: equal conversations are one, of their number's weight
    seqs = written(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("all_words").alias("all_words")), "sequences")

    facts = seqs.select("conv_id", "weight", "all_words")
    below = (run.join(places.join(facts, "conv_id"), ["part", "conv_id"])
             .selectExpr("part", "conv_id", "weight", "depth", "words", "all_words - upto + words as rest", *_key("depth", SUMS),
                         *_key("depth - 1", [f"{s} - {x}" for s, x in zip(SUMS, HASH, strict=True)], ("up_a", "up_b"))))
    zero = ["0L"] * len(SUMS)
    heads = (facts.join(convs.select("conv_id", "head"), "conv_id").select("*", F.posexplode("head").alias("at", "t"))
             .selectExpr("conv_id", "weight", "all_words", "at + 1L as depth", "t.*",
                         *[f"if(at = 0, 0L, element_at(head, greatest(at, 1)).{s}) as up_{s}" for s in SUMS])
             .selectExpr("-1 as part", "conv_id", "weight", "depth", "words", "all_words - upto + words as rest", *_key("depth", SUMS),
                         *_key("depth - 1", [f"up_{s}" for s in SUMS], ("up_a", "up_b"))))
    top = facts.selectExpr("-1 as part", "conv_id", "weight", "0L as depth", "0L as words", "all_words as rest", *_key("0", zero),
                           "cast(null as bigint) as up_a", "cast(null as bigint) as up_b")
    prefixes = written(below.unionByName(heads).unionByName(top), "prefixes")

    nodes = written(prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("words").alias("words"),
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.sum(F.expr("weight * rest")).alias("member_words")), "nodes")
    family = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count("*").alias("n_children"), salts_used(F.xxhash64("a", "b")))
    family = written(family, "families")
    leaves = seqs.join(family, NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))  # not a proper prefix of another
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("words").alias("own_words"))
    facts = facts.select("conv_id").join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    where = places.unionByName(seqs.selectExpr("-1 as part", "conv_id"))
    sums = (prefixes.join(where.join(facts, "conv_id"), ["part", "conv_id"]).groupBy(*NODE)
            .agg(F.sum("leaf").alias("n_leaves"), F.sum(F.expr("if(top is null, 0, if(depth >= top, rest, own_words))")).alias("node_words")))

    known = nodes.join(sums, NODE).join(family.drop("__salts"), NODE, "left").join(end_digests(ends.select("conv_id", *NODE)), NODE, "left")
    parents = family.join(nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id")), NODE).selectExpr(
        "depth + 1 as depth", "a as up_a", "b as up_b", "parent_conv_id", "__salts")
    named = salted_join(known.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("up_a", "up_b")}), parents, ["depth", "up_a", "up_b"], F.xxhash64("a", "b"), how="left")
    return named.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), (F.col("member_words") - F.col("node_words")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
