"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

Words are counted over whole texts, then compared in tiles. Two words whose
longer one has l code points are one edit apart if their common prefix and
common suffix add up to l - 1 at least. The places 0 .. l - 1 at which a common
prefix can end are cut into intervals of two; a pair whose prefix ends in the
interval [a, b) shares its first a and its last l - b code points. So a word is
dealt out once for each interval, as the longer and as the shorter word of a
pair, under these two affixes, and every pair of neighbours meets in exactly one
tile. A tile's words are rows of a padded code-point matrix (all code points are
below 256), whose blocks are compared pair by pair with one expression.

The words of a tile differ in at most two code points, so a tile has at most
90 * 90 + 90 words, whatever the vocabulary (words of over 64 code points have
32 intervals, wider ones, which bounds the rows that a long word makes). A tile
returns a count and the best neighbour for each word, not its pairs. Forms are
followed to their roots by pointer doubling.

Defined cases: null and empty texts have no words; a null id counts as an empty
decimal in the hash; repeated rows count again; runs of any length are words; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemstats.llm.common import remove, salted_join, small_batches, text_bytes, written

#: Maximal runs of [A-Za-zÀ-ÿ] in UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
LATIN = "ISO-8859-1"
#: Words of more code points than this have INTERVALS intervals.
SHORT, INTERVALS = 64, 32


def corrupted(run: bytes, h: int) -> str:
    """The run without the code point that its hash names."""
    text = run.decode()
    i = h % len(text)
    return text[:i] + text[i + 1:]


def _counts(min_length: int, modulus: int, at_most: int = 1 << 17):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = [(w.decode(), n) for w, n in seen.items()]
            words = [(w, n) for w, n in words if n and len(w) >= min_length]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()),
                                               pa.array([n for _, n in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for own, text in zip(batch.column("own"), batch.column("text"), strict=True):
                start = zlib.crc32(own.as_py() + b":")
                runs = [w for w in RUN.findall(text.as_py().lower()) if len(w) >= min_length]
                seen.update(runs)
                for w in runs:
                    h = zlib.crc32(w, start)
                    if h % modulus == 0:
                        seen[w] -= 1
                        seen[corrupted(w, h).encode()] += 1
                if len(seen) > at_most:
                    yield out()
        yield out()

    return counts


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, modulus: int = 31) -> DataFrame:
    """word, n: the runs of at least ``min_length`` code points after the
    deletions, that occur at least ``min_count`` times."""
    small_batches(docs.sparkSession)
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary").alias("own")
    found = docs.select(own, text_bytes().alias("text")).mapInArrow(_counts(min_length, modulus), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def interval(l: str, t: str) -> str:
    """SQL: the first place of interval t among the l places."""
    return f"cast(floor({t} * {l} / if({l} > {SHORT}, {INTERVALS}, ceil({l} / 2))) as int)"


def tiles(words: DataFrame) -> DataFrame:
    """key, l, a, b, word (Latin-1 bytes), n: each word once for each interval
    of l places, for l of its length and one more."""
    dealt = (words.selectExpr("word", "n", "explode(array(length(word), length(word) + 1)) as l")
             .selectExpr("*", f"explode(sequence(0, if(l > {SHORT}, {INTERVALS}, cast(ceil(l / 2) as int)) - 1)) as t")
             .selectExpr("word", "n", "l", f"{interval('l', 't')} as a", f"{interval('l', '(t + 1)')} as b"))
    return dealt.selectExpr("xxhash64(l, a, left(word, a), right(word, l - b)) as key", "l", "a", "b",
                            f"encode(word, '{LATIN}') as word", "n")


def _matrix(data: np.ndarray, starts: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words as rows, padded at the right, and reversed."""
    place = np.arange(width)
    inside = place < length[:, None]
    last = len(data) - 1
    fore = np.where(inside, data[np.minimum(starts[:, None] + place, last)], 0)
    back = np.where(inside, data[np.clip((starts + length)[:, None] - 1 - place, 0, last)], 0)
    return fore.astype(np.uint8), back.astype(np.uint8)


def _common(m: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading code points rows i and j share, ``most`` at most."""
    other = m[i] != m[j]
    return np.minimum(np.where(other.any(1), other.argmax(1), m.shape[1]), most)


def _near_pairs(fore, back, length, l, a, b, i, j) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) of one tile that are one edit apart and whose
    common prefix ends in the tile's interval."""
    one = (length[i] == l[i]) | (length[j] == l[i])
    i, j = i[one], j[one]
    least = np.minimum(length[i], length[j])
    p = _common(fore, i, j, least)
    at = np.minimum(p, l[i] - 1)
    good = (p + _common(back, i, j, least) >= l[i] - 1) & (a[i] <= at) & (at < b[i])
    return i[good], j[good]


def _pairs_of(starts: np.ndarray, n: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each tile, some at a time: by distance in small
    tiles, by blocks in large ones."""
    small = n <= 64
    row = np.concatenate([np.arange(s, s + k) for s, k in zip(starts[small], n[small], strict=True)] or [np.empty(0, np.int64)])
    stop = np.repeat(starts[small] + n[small], n[small])
    for d in range(1, int(n[small].max()) if small.any() else 0):
        i = row[row + d < stop]
        for k in range(0, len(i), at_once):
            yield i[k:k + at_once], i[k:k + at_once] + d
    side = max(1, int(at_once ** 0.5))
    for s, k in zip(starts[~small].tolist(), n[~small].tolist(), strict=True):
        for x in range(s, s + k, side):
            for y in range(x, s + k, side):
                i, j = (v.ravel() for v in np.meshgrid(np.arange(x, min(x + side, s + k)), np.arange(y, min(y + side, s + k)), indexing="ij"))
                yield i[i < j], j[i < j]


def _tile(key: np.ndarray, l: np.ndarray, a: np.ndarray, b: np.ndarray, words: pa.Array, n: np.ndarray,
          room: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of whole tiles, sorted by tile and word: rows with
    neighbours, how many, and the row of the best one."""
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (l[1:] != l[:-1]) | (a[1:] != a[:-1])]))
    size = np.diff(np.append(new, len(key)))
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for wide in (False, True):
        runs = [np.flatnonzero((size > 1) & (l[new] <= SHORT))] if not wide else [[r] for r in np.flatnonzero((size > 1) & (l[new] > SHORT))]
        for run in runs:  # long words by tile, so that one doesn't pad all
            starts, count = new[run], size[run]
            if not len(starts):
                continue
            rows = np.repeat(starts - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            length = np.diff(offsets)[rows]
            width = int(length.max())
            fore, back = _matrix(data, offsets[rows], length, width)
            own = (length, l[rows], a[rows], b[rows])
            for i, j in _pairs_of(np.concatenate([[0], np.cumsum(count)[:-1]]), count, max(16, room // width)):
                i, j = _near_pairs(fore, back, *own, i, j)
                if len(i):
                    found.append((rows[i], rows[j]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    at, other = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((other, -n[other], at))  # rows of a tile are in code-point order
    at, other = at[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.diff(np.append(first, len(at))), other[first]


def _neighbours(at_least: int = 1 << 16):
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            key, l, a, b, n = (rows.column(c).to_numpy() for c in ("key", "l", "a", "b", "n"))
            words = rows.column("word").combine_chunks()
            at, count, best = _tile(key, l.astype(np.int64), a.astype(np.int64), b.astype(np.int64), words, n)
            return pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(count), pa.array(n[best], pa.int64()), words.take(pa.array(best))],
                                              names=["word", "near", "best_n", "best"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < at_least and sum(x.nbytes for x in held) < 1 << 24:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last tile may go on
            if cut:
                yield out(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield out(pa.Table.from_batches(held))

    return neighbours


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n for each of the distinct ``words(word, n)``
    that has words one edit apart; best has the largest n, then the smallest word."""
    small_batches(words.sparkSession)
    dealt = tiles(words)
    found = (dealt.repartition("key").sortWithinPartitions("key", "l", "a", "word")
             .mapInArrow(_neighbours(), "word binary, near bigint, best_n bigint, best binary"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), best)
            .select(F.decode("word", LATIN).alias("word"), "n_near", F.decode("b.best", LATIN).alias("best"), (-F.col("b.less")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for ``forms(word, form)`` (one row a word, no cycles): the
    end of each word's chain of forms, which doubles its steps each round."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(step, "root", "left_semi").isEmpty():
            return at
        ahead = salted_join(at, step, ["root"], F.col("word"), how="left")
        previous, at = at, written(ahead.select("word", F.coalesce("next", "root").alias("root")), "roots")
        remove(previous)


def spelling_forms(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, modulus: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word: its form is the
    neighbour of largest n (then smallest), if that is at least ``ratio`` times
    the word's n; its root is where its chain of forms ends."""
    words = written(word_counts(docs, min_length, min_count, modulus), "words")
    near = neighbours(words)
    judged = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(F.col("best_n") >= ratio * F.col("n"), F.col(c)).alias(name) for c, name in (("best", "form"), ("best_n", "form_n"))]), "judged")
    ends = roots(judged.filter("form is not null"))
    return (judged.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
