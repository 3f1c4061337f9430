"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share
all words of the corpus by weight. A target stops at ``max_epochs`` times its
source's size; what is above is shared again by weight among the others, until
none is above. A source is taken in whole epochs first; the rest of its target
is a weighted sample without replacement: each document gets the exponential
key ``-ln(u) / quality`` with u from a hash of its id and text, and documents
are taken in key order while the running sum of words, at a document's middle,
is below the rest. So a source misses its target by at most half the document
at the edge.

Only the edge needs an order: keys are cut into bins, words are summed by
(source, bin) before any shuffle, and only the bin in which the rest runs out
is sorted. All of it is DataFrame and SQL functions.

Defined cases: null text has size 0; null sources are one source, the last;
an empty or wordless source has target 0; null ids and repeated rows get a row
each (equal rows share their key and are ordered by id and text hash, then
arbitrarily, as they are the same); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemstats.llm.common import salted_join, written

#: Cuts of the key range; more make the sorted edge smaller.
BINS = 4096


def words_of(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    return F.expr(rf"coalesce(regexp_count({text}, '[^\\x20\\x09-\\x0D]+'), 0)").cast("long")


def quality_weight(text: str = "text") -> Column:
    """A document's weight, 0.1 to 1: the share of its characters that are
    neither symbols nor digits."""
    clean = F.expr(rf"coalesce(length({text}) - regexp_count({text}, '[#$%&*!|0-9]'), 0)")
    return F.lit(0.1) + F.lit(0.9) * clean / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))


def uniform(doc_id: str, text: str, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of md5 of seed, id and text."""
    mixed = F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    bits = F.conv(F.substring(F.md5(mixed.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> with target. One row per source.

    With sources by the ratio of cap to weight, a source is capped exactly if
    sharing what the capped ones before it leave would put it above its cap.
    """
    kinds = ",".join(str(w) for w in weights)
    ranked = sizes.selectExpr("*", f"element_at(array({kinds}), cast((row_number() over (order by source asc nulls last) - 1) "
                                   f"% {len(weights)} + 1 as int)) as weight",
                              f"{max_epochs} * source_size as cap", "sum(source_size) over () as total")
    order = "(order by cap / weight, source asc nulls last rows between"
    left = ranked.selectExpr("*", f"total - coalesce(sum(cap) over {order} unbounded preceding and 1 preceding), 0) as rest",
                             f"sum(weight) over {order} current row and unbounded following) as open_weight")
    judged = left.selectExpr("*", "cap * open_weight <= rest * weight as capped")
    return judged.selectExpr(
        "source", "source_size",
        "cast(if(capped, cap, weight * (total - sum(if(capped, cap, 0)) over ()) "
        "/ nullif(sum(if(capped, 0, weight)) over (), 0)) as double) as target")


def mix(docs: DataFrame, seed: int = 7, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3),
        quality: Column | None = None, bins: int = BINS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, mark (xxhash64 of
    doc_id, source and text) for each row."""
    quality = quality_weight() if quality is None else quality
    key = -F.ln(uniform("doc_id", "text", seed)) / F.greatest(quality, F.lit(1e-6))
    rows = written(docs.select("doc_id", "source", words_of().alias("size"), key.alias("key"),
                               F.xxhash64("doc_id", "source", "text").alias("mark"))
                   .withColumn("bin", F.floor(F.lit(bins) * (F.lit(1.0) - F.exp(-F.col("key")))).cast("int")), "mixing")
    by_bin = written(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mixing-bins")
    aims = targets(by_bin.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")), max_epochs, weights)
    plan = aims.selectExpr("*", "if(source_size = 0, 0, cast(floor(target / source_size) as int)) as epochs") \
               .selectExpr("*", "target - epochs * source_size as rest")
    running = by_bin.selectExpr("source", "bin", "words",
                                "sum(words) over (partition by source order by bin) - words as before")
    edge = (running.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source"))
            .filter("before < rest").groupBy("p.source", "p.source_size", "p.target", "p.epochs", "p.rest")
            .agg(F.max(F.struct("bin", "before")).alias("e"))
            .selectExpr("source as a_source", "e.bin as edge_bin", "e.before as edge_before"))
    named = (plan.join(edge, F.expr("source <=> a_source"), "left")
             .selectExpr("coalesce(concat('s', source), 'null') as name", "source_size", "target", "epochs", "rest",
                         "coalesce(edge_bin, -1) as edge_bin", "coalesce(edge_before, 0) as edge_before"))
    held = salted_join(rows.withColumn("name", F.expr("coalesce(concat('s', source), 'null')")), named, ["name"],
                       F.col("mark"), 32)
    at_edge = (held.filter("bin = edge_bin")
               .withColumn("before", F.expr("edge_before + sum(size) over (partition by name order by key, doc_id, mark "
                                            "rows between unbounded preceding and current row) - size"))
               .withColumn("more", F.expr("before + size / 2.0 < rest")))
    away = held.filter("bin != edge_bin").withColumn("more", F.expr("bin < edge_bin"))
    out = at_edge.drop("before").unionByName(away)
    return (out.withColumn("copies", F.expr("epochs + cast(more as int)"))
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "mark"))
