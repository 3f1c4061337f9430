"""Language-model scores: causal self-attention over subword ids.

Words (``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z) are cut into subwords of
a public byte-level BPE, each with the space before it; one end follows. The
commonest subwords are a class each, the others share a few classes; the model
(``attention.py``) predicts the next class, and a subword within its class has
its share of the training corpus. Windows of ``CONTEXT`` places overlap by
``OVERLAP``: every token is scored once, with at least that many places before
it (fewer only at the start of a text).

Word by word, the attention's spelling of a word (given that a word starts,
and that it ends there) is mixed with the word's share of the training corpus,
so the score is the log10 of a proper probability: known words profit from the
corpus, unknown ones from their spelling and context.

What is learned: word counts, subword counts and class shares come from every
training document. The attention weights are fitted on all windows of all training
documents, by local Adam runs on disjoint parts that are averaged round by round. The
``head`` most frequent words travel to the tasks as a table of fixed size;
all rarer words meet their counts in a shuffle join.

Defined cases: a null or empty text is one end; a null id belongs to the
training part; repeated rows each count and get a row; with no training
document every share is that of unseen words; an empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemstats.llm import attention
from gemstats.llm.common import fold, remove, small_batches, text_bytes, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: A word's pieces: letters, digits or others with the space before them.
PIECES = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_WORD = b"\n"  # no word has white space
CONTEXT, OVERLAP = 32, 8
STEP = CONTEXT - OVERLAP
CLASSES, SHARED, WIDTH = 192, 16, 16
LN10 = np.log(10)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tuple[tiktoken.Encoding, np.ndarray, int]:
    """The tokenizer, which of its ids start with a space, and the end's id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    end = max(ranks.values()) + 1
    starts = np.zeros(end + 1, bool)
    starts[[i for b, i in ranks.items() if b[:1] == b" "]] = True
    starts[end] = True
    return tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), starts, end


def subwords(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and how many each word has."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    encoding, starts, _ = tokenizer(path)
    ids = np.asarray(encoding.encode_to_numpy(b"".join(b" " + w for w in words).decode("utf-8", "replace"))).astype(np.int32)
    at = np.flatnonzero(starts[ids])
    if len(at) != len(words):  # not known to occur: each word by itself
        own = [encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        return np.array([i for x in own for i in x], np.int32), np.array([len(x) for x in own], np.int64)
    return ids, np.diff(np.concatenate([at, [len(ids)]]))


def _count_words(at_most: int = 300_000):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                              names=["word", "c"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(t.as_py().lower().split())
                seen[END_WORD] += 1
                if len(seen) > at_most:
                    yield out()
                    seen.clear()
        yield out()

    return counted


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; the end is a line feed), c over all of docs."""
    return (docs.select(text_bytes().alias("data")).mapInArrow(_count_words(), "word binary, c bigint")
            .groupBy("word").agg(F.sum("c").alias("c")))


def subword_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each id occurs; one row an id comes to the driver."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = tokenizer(path)[2]
        total = np.zeros(end + 1, np.int64)
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            real = [i for i, w in enumerate(words) if w != END_WORD]
            ids, n = subwords([words[i] for i in real], path)
            total += np.bincount(ids, weights=np.repeat(c[real], n), minlength=end + 1).astype(np.int64)
            total[end] += sum(int(x) for x, w in zip(c, words, strict=True) if w == END_WORD)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["id", "n"])

    found = counts.mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(tokenizer(path)[2] + 1, np.int64)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


class Classes(NamedTuple):
    of: np.ndarray  # class of each id
    within: np.ndarray  # natural log of the id's share of its class
    shares: np.ndarray  # of the classes
    starts: np.ndarray  # 1 for classes of ids that start a word


def classes(counts: np.ndarray, path: str, n: int = CLASSES, shared: int = SHARED) -> Classes:
    """The commonest ids and the end have a class each; the others go by rank and by
    whether they start a word."""
    starts = tokenizer(path)[1]
    end = len(counts) - 1
    order = np.argsort(-counts, kind="stable")
    order = np.concatenate([[end], order[order != end]])
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    own = n - shared
    depth = np.minimum(np.log2(np.maximum(rank - own, 0) + 32).astype(np.int64) - 5, shared // 2 - 1)
    of = np.where(rank < own, rank, own + starts * (shared // 2) + depth)
    smooth = counts + 0.1
    total = np.bincount(of, weights=smooth, minlength=n)
    begins = np.zeros(n, np.float32)
    begins[of[starts]] = 1
    return Classes(of.astype(np.int16), np.log(smooth / total[of]), np.maximum(total, 0.1) / np.maximum(total, 0.1).sum(), begins)


def windows(ids: np.ndarray, n: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class ids of texts with n tokens each -> inputs (windows x CONTEXT), next
    classes and 1 for real places (windows x STEP). Each token is next once."""
    k = -(-n // STEP)
    rows = np.concatenate([[0], np.cumsum(k)])
    flat = np.full(rows[-1] * STEP, blank, np.int16)
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(len(ids)) + np.repeat(rows[:-1] * STEP - begin, n)
    flat[place] = ids
    nexts = flat.reshape(-1, STEP)
    real = (nexts != blank).astype(np.float32)
    before = np.full((rows[-1], OVERLAP + 1), blank, np.int16)  # what the window before ends with
    before[1:] = nexts[:-1, -(OVERLAP + 1):]
    before[rows[:-1][k > 0]] = blank
    return np.hstack([before, nexts[:, :-1]]), np.where(nexts == blank, 0, nexts), real


class Head(NamedTuple):
    """The most frequent words; index -1 stands for any other."""
    index: dict[bytes, int]
    ids: np.ndarray
    begin: np.ndarray
    n: np.ndarray
    known: np.ndarray  # natural log of the word's share


class Tokens(NamedTuple):
    ids: np.ndarray  # subwords of all texts, an end after each
    per_text: np.ndarray  # their number, ends left out
    count: np.ndarray  # words of each text
    at: np.ndarray  # each word's place in the head, -1 for others
    others: list[bytes]
    begin: np.ndarray  # first subword of each word, ends left out


def tokens_of(texts: list[bytes], head: Head, path: str) -> Tokens:
    """Only words that aren't in the head pass through the tokenizer."""
    end, index = tokenizer(path)[2], head.index
    split = [t.lower().split() for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    words = [w for ws in split for w in ws]
    at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
    rare = at < 0
    others = [words[i] for i in np.flatnonzero(rare)]
    own_ids, own_n = subwords(others, path)
    n = np.ones(len(words), np.int64)
    n[~rare], n[rare] = head.n[at[~rare]], own_n
    source = np.zeros(len(words), np.int64)
    source[~rare], source[rare] = head.begin[at[~rare]], np.cumsum(own_n) - own_n
    begin = np.cumsum(n) - n
    flat = np.repeat(source - begin, n) + np.arange(int(n.sum()))
    from_head = np.repeat(~rare, n)
    ids = np.empty(len(flat), np.int32)
    ids[from_head], ids[~from_head] = head.ids[flat[from_head]], own_ids[flat[~from_head]]
    per_text = np.bincount(np.repeat(np.arange(len(texts)), count), weights=n, minlength=len(texts)).astype(np.int64)
    return Tokens(np.insert(ids, np.cumsum(per_text), end), per_text, count, at, others, begin)


def _windows_of(path: str, kinds: Classes, head: Head, at_once: int = 1 << 20):
    """A row a window: a byte for each class of its inputs, and the last next one."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i, t in enumerate(batch.column(0)):
                held.append(t.as_py())
                size += len(held[-1])
                if size > at_once or i == batch.num_rows - 1:
                    own = tokens_of(held, head, path)
                    x, y, w = windows(kinds.of[own.ids], own.per_text + 1, CLASSES)
                    flat = np.empty((len(x), CONTEXT + 1), np.uint8)
                    flat[:, :CONTEXT], flat[:, CONTEXT] = x, np.where(w[:, -1] > 0, y[:, -1], CLASSES)
                    begin = np.arange(len(x) + 1, dtype=np.int32) * (CONTEXT + 1)
                    rows = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(begin), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays([rows], names=["w"])
                    held, size = [], 0

    return cut


def _flat(m: attention.Weights) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in sorted(m)])


def _shaped(flat: np.ndarray, like: attention.Weights) -> attention.Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def fit(docs: DataFrame, kinds: Classes, path: str, rounds: int, per_task: int, rate: float, head: Head) -> attention.Weights:
    """Local Adam runs over all windows of docs, a part of them each round, averaged
    after it. Which round and task a window is in depends on what it holds and on
    its number among equal ones. A task gets enough windows for LEAST_STEPS steps over
    each once; windows are used again only if a round has too few for that."""
    model = attention.start(CLASSES + 1, kinds.shares, CONTEXT, WIDTH)
    cut = written(docs.select(text_bytes()).mapInArrow(_windows_of(path, kinds, head), "w binary")
                  .groupBy("w").agg(F.count("*").alias("copies")), "windows")
    every = cut.select("w", F.explode(F.expr("sequence(1, copies)")).alias("k")).withColumn("deal", F.xxhash64("w", "k"))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [w for batch in batches for w in batch.column("w").to_pylist()]  # about per_task windows
        if rows:
            data = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1).astype(np.int64)
            x, y = data[:, :CONTEXT], data[:, OVERLAP + 1:]
            real = (y != CLASSES).astype(np.float32)
            m = attention.train(model, x, np.where(y == CLASSES, 0, y), real, OVERLAP, now, epochs=1, least_steps=least_steps)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([_flat(m).astype(np.float64)])], names=["n", "m"])

    total = int(cut.agg(F.sum("copies")).first()[0] or 0)
    tasks = max(1, total // (rounds * max(per_task, attention.BATCH * attention.LEAST_STEPS)))  # of a round
    least_steps = attention.LEAST_STEPS if tasks == 1 else 1
    for r in range(rounds if total else 0):
        now = rate * 0.5 ** (4 * r / rounds)
        parts = (every.filter(F.pmod("deal", F.lit(rounds)) == r)
                 .repartition(tasks, "deal"))
        mean = (parts.mapInArrow(trained, "n bigint, m array<double>")
                .select("n", F.posexplode("m").alias("i", "v"))
                .groupBy("i").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")).orderBy("i").toArrow())
        if mean.num_rows:
            model = _shaped(mean.column("v").to_numpy(), model)
    remove(cut)
    return model


def _score(texts: list[bytes], head: Head, kinds: Classes, model: attention.Weights, end_known: float, path: str, mixed: float) -> dict:
    """Sums a text over the words of the head and the end, and its other words."""
    own = tokens_of(texts, head, path)
    tokens, per_text, count, at, others = own.ids, own.per_text, own.count, own.at, own.others
    rare = at < 0
    text = np.repeat(np.arange(len(texts)), count)
    start = np.insert(own.begin + text, np.cumsum(count), np.cumsum(per_text) + np.arange(len(texts)))
    x, y, real = windows(kinds.of[tokens], per_text + 1, CLASSES)
    lp, ls = (p[real > 0] for p in attention.log_probs(model, x, y, OVERLAP, kinds.starts))
    lp = lp.astype(np.float64) + kinds.within[tokens]
    spelled = np.add.reduceat(lp, start) - ls[start]
    is_end = np.zeros(len(start), bool)
    is_end[np.cumsum(count + 1) - 1] = True
    spelled[:-1] += np.where(is_end[:-1], 0, ls[start[1:]])
    known = np.full(len(start), end_known)
    known[~is_end] = np.where(rare, 0, head.known[at])
    both = np.logaddexp(np.log(mixed) + known, np.log1p(-mixed) + spelled)
    use = is_end.copy()
    use[~is_end] = ~rare
    owner = np.repeat(np.arange(len(texts)), count + 1)
    total = lambda v: np.bincount(owner, weights=np.where(use, v, 0), minlength=len(texts))
    return {"n_tokens": count + 1, "known": np.bincount(text, weights=~rare, minlength=len(texts)).astype(np.int64),
            "base": total(known) / LN10, "score": total(both) / LN10,
            "words": others, "spelled": spelled[~is_end][rare] / LN10,
            "offsets": np.concatenate([[0], np.cumsum(np.bincount(text, weights=rare, minlength=len(texts)))]).astype(np.int32)}


def _scored(at_once: int = 1 << 20, **params):
    @F.arrow_udf("struct<n_tokens:bigint,known:bigint,base:double,score:double,rare:array<struct<word:binary,spelled:double>>>")
    def scored(texts: pa.Array) -> pa.Array:
        parts, held, size = [], [], 0

        def flush() -> None:
            s = _score(held, **params)
            rare = pa.ListArray.from_arrays(pa.array(s["offsets"]), pa.StructArray.from_arrays(
                [pa.array(s["words"], pa.binary()), pa.array(s["spelled"], pa.float64())], names=["word", "spelled"]))
            parts.append(pa.StructArray.from_arrays([*(pa.array(s[k]) for k in ("n_tokens", "known", "base", "score")), rare],
                                                    names=["n_tokens", "known", "base", "score", "rare"]))

        for t in texts:
            held.append(t.as_py())
            size += len(held[-1])
            if size > at_once:
                flush()
                held, size = [], 0
        if held:
            flush()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([
            ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
            ("rare", pa.list_(pa.struct([("word", pa.binary()), ("spelled", pa.float64())])))]))

    return scored


def lm_scores(docs: DataFrame, path: str = TOKENIZER, head_words: int = 100_000, mixed: float = 0.75, rounds: int = 4,
              per_task: int = 8192, rate: float = 1e-2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    each row. Learns from ids whose crc32 modulo 5 is not 1. ``mixed`` is the
    weight of a word's corpus share against its spelling; at least about ``per_task``
    windows make one local training run."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    training = docs.filter(fold("doc_id", 5) != 1)
    counts = written(word_counts(training), "words")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    ends = counts.filter(F.col("word") == F.lit(END_WORD)).first()
    n_docs = ends["c"] if ends else 0
    unit = total + 0.5 * (distinct + 1)

    sub = subword_counts(counts, path)
    kinds = classes(sub, path)
    top = counts.filter(F.col("word") != F.lit(END_WORD)).orderBy(F.desc("c"), "word").limit(head_words).toArrow()
    common = top.column("word").to_pylist()
    ids, n = subwords(common, path)
    shares = np.log((top.column("c").to_numpy() + 0.5) / unit) if common else np.zeros(1)
    head = Head({w: i for i, w in enumerate(common)}, ids, np.cumsum(n) - n, n, shares)

    model = fit(training, kinds, path, rounds, per_task, rate, head)
    share = _scored(head=head, kinds=kinds, model=model, end_known=float(np.log((n_docs + 0.5) / unit)), path=path, mixed=mixed)
    rows = written(docs.withColumn("s", share(text_bytes()))
                   .select(F.monotonically_increasing_id().alias("row"), "doc_id", "s.*"), "lm-rows")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.spelled")
    known = F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.5)) / F.lit(unit))
    a, b = known + F.lit(float(np.log10(mixed))), F.col("spelled") + F.lit(float(np.log10(1 - mixed)))
    high = F.greatest(a, b)
    met = rare.join(counts, "word", "left").select(
        "row", (F.col("c") > 0).cast("long").alias("known"), known.alias("base"),
        (high + F.log10(F.pow(F.lit(10.0), a - high) + F.pow(F.lit(10.0), b - high))).alias("score"))
    met = met.groupBy("row").agg(*[F.sum(c).alias(f"rare_{c}") for c in ("known", "base", "score")])
    plus = lambda c: F.col(c) + F.coalesce(f"rare_{c}", F.lit(0))
    return rows.join(met, "row", "left").select(
        "doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens",
        (plus("known") + F.lit(int(n_docs > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base").alias("base_score"), plus("score").alias("score"))
