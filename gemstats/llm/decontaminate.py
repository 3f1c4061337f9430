"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

All n-grams of a test item are seeds, however many training documents have
them. Where a document has a seed, the passage around it is aligned with the item
by Smith-Waterman (match 2, mismatch and gap -1), unless it has too few words of
the item for the threshold; a best score of at least ``threshold`` times the
item's own (2 a word) is a leak. Words may be changed, added or left out.

Items are joined to the documents in blocks of bounded size, each a table that
travels to the tasks; one pass over the documents a block, and no shuffle of
texts.

Defined cases: null and empty texts have no leaks; items of fewer than ``n``
words can't be told from chance and never match; null items are empty; equal
items and repeated rows are each reported; null ids are reported as null;
empty tables give an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemstats.llm.common import small_batches, text_bytes

MATCH, MISS, GAP = 2, -1, -1
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(LETTERS).split()


class Items(NamedTuple):
    """A block of test items: words as numbers (0: a word of no item), and the
    n-grams, sorted, with the places (item, offset) of each; ``member`` has the
    words of each item as item * words + word, sorted."""
    ids: list
    tokens: list[np.ndarray]
    vocabulary: dict[bytes, int]
    n: int
    grams: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    member: np.ndarray


def _codes(tokens: np.ndarray, n: int, base: int) -> np.ndarray:
    """A number for each n-gram; -1 where a word of no item takes part."""
    m = max(0, len(tokens) - n + 1)
    code, whole = np.zeros(m, np.int64), np.ones(m, bool)
    for k in range(n):
        part = tokens[k:k + m]
        code = code * base + part
        whole &= part > 0
    return np.where(whole, code, -1)


def block(rows: list[tuple], n: int) -> Items:
    vocabulary: dict[bytes, int] = {}
    tokens = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)], np.int64) for _, t in rows]
    if (len(vocabulary) + 1) ** n >= 1 << 63:
        raise ValueError("too many different words in a block; use smaller blocks")
    codes = [_codes(t, n, len(vocabulary) + 1) for t in tokens]
    code = np.concatenate([np.empty(0, np.int64), *codes])
    item = np.repeat(np.arange(len(rows)), [len(c) for c in codes])
    offset = np.concatenate([np.empty(0, np.int64), *(np.arange(len(c)) for c in codes)])
    order = np.lexsort((offset, item, code))
    grams, begin = np.unique(code[order], return_index=True)
    member = np.unique(np.concatenate([np.empty(0, np.int64), *(k * (len(vocabulary) + 1) + t for k, t in enumerate(tokens))]))
    return Items([i for i, _ in rows], tokens, vocabulary, n, grams, np.append(begin, len(code)), item[order], offset[order], member)


def _numbered(texts: list[bytes], items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers, a 0 after each text, and their places."""
    get, flat, ends = items.vocabulary.get, [], []
    for t in texts:
        flat.extend([get(w, 0) for w in words(t)])
        flat.append(0)
        ends.append(len(flat))
    return np.array(flat, np.int64), np.array([0, *ends], np.int64)


def _found(tokens: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Places in tokens and numbers of the n-grams there."""
    code = _codes(tokens, items.n, len(items.vocabulary) + 1)
    at = np.flatnonzero(code >= 0)
    if not len(at) or not len(items.grams):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    near = np.minimum(np.searchsorted(items.grams, code[at]), len(items.grams) - 1)
    hit = items.grams[near] == code[at]
    return at[hit], near[hit]


def _chunks(texts: pa.Array, at_once: int) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1])
        if size > at_once:
            yield held
            held, size = [], 0
    if held:
        yield held


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair and where in b it ends, for
    many pairs at once, a row of the matrix at a time."""
    m, w = max(map(len, a)), max(map(len, b))
    x, y = np.full((len(a), m), -1, np.int32), np.full((len(b), w), -2, np.int32)
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x[i, :len(p)], y[i, :len(q)] = np.where(p == 0, -1, p), np.where(q == 0, -2, q)
    shift = (-GAP * np.arange(w + 1)).astype(np.int32)
    row, best, end = np.zeros((len(a), w + 1), np.int32), np.zeros(len(a), np.int32), np.zeros(len(a), np.int64)
    for i in range(m):
        new = np.maximum(row + GAP, 0)
        np.maximum(new[:, 1:], row[:, :-1] + np.where(y == x[:, i:i + 1], MATCH, MISS), out=new[:, 1:])
        row = np.maximum.accumulate(new + shift, axis=1) - shift  # gaps along b
        top = row.max(1)
        more = top > best
        if more.any():
            best = np.where(more, top, best)
            end = np.where(more, row.argmax(1), end)
    return best, end


def _candidates(at: np.ndarray, gram: np.ndarray, ends: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(document, item, begin, end): passages around seeds, merged where they meet."""
    n = np.diff(items.begin)[gram]
    place = np.repeat(items.begin[gram] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    at, item = np.repeat(at, n), items.item[place]
    doc = np.searchsorted(ends, at, "right") - 1
    size = np.array([len(t) for t in items.tokens], np.int64)[item]
    slack = size // 4 + 4
    begin = np.maximum(at - items.offset[place] - slack, ends[doc])
    end = np.minimum(at - items.offset[place] + size + slack, ends[doc + 1] - 1)
    order = np.lexsort((end, begin, item, doc))  # so that ends rise within a document and item
    doc, item, begin, end = (v[order] for v in (doc, item, begin, end))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
    return doc[new], item[new], begin[new], end[np.append(new[1:], True)]


def _shared(tokens: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, items: Items, cells: int = 1 << 21) -> np.ndarray:
    """How many words of each passage its item has."""
    out, size, at = np.zeros(len(item), np.int64), end - begin, 0
    total = np.cumsum(size)
    while at < len(item):
        to = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + cells, "right")))
        n = size[at:to]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        word = tokens[np.repeat(begin[at:to] - first, n) + np.arange(int(n.sum()))]
        code = np.repeat(item[at:to] * (len(items.vocabulary) + 1), n) + word
        near = np.minimum(np.searchsorted(items.member, code), len(items.member) - 1)
        hit = np.concatenate([[0], np.cumsum((items.member[near] == code) & (word > 0))])
        out[at:to] = hit[first + n] - hit[first]
        at = to
    return out


def _parts(at: np.ndarray, gram: np.ndarray, ends: np.ndarray, items: Items, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The seeds of whole documents, as many together as have ``most`` places in items."""
    total = np.cumsum(np.diff(items.begin)[gram])
    last = np.searchsorted(at, ends[np.searchsorted(ends, at, "right")])  # where each seed's document ends
    lo = 0
    while lo < len(at):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right"))
        cut = int(last[lo])
        if hi > cut:
            cut = len(at) if hi == len(at) else int(np.searchsorted(at, ends[np.searchsorted(ends, at[hi], "right") - 1]))
        yield at[lo:cut], gram[lo:cut]
        lo = cut


def _leaks(texts: list[bytes], items: Items, threshold: float, together: int = 64, cells: int = 1 << 22) -> list[list[tuple]]:
    """For each text: (item id, score, begin, end) of its leaks, in words."""
    tokens, ends = _numbered(texts, items)
    found: list[dict[int, tuple]] = [{} for _ in texts]
    waiting = []
    size = np.array([len(t) for t in items.tokens], np.int64)
    for part in _parts(*_found(tokens, items), ends, items):
        doc, item, begin, end = _candidates(*part, ends, items)
        # a match needs words of the item in the passage
        use = _shared(tokens, item, begin, end, items) >= threshold * size[item]
        doc, item, begin, end = (v[use] for v in (doc, item, begin, end))
        waiting.extend(zip(*(v.tolist() for v in (size[item], end - begin, doc, item, begin, end)), strict=True))
    waiting.sort()
    at = 0
    while at < len(waiting):
        part = waiting[at:at + together]
        part = part[:max(1, cells // max(w for _, w, *_ in part))]
        at += len(part)
        a, b = [items.tokens[x[3]] for x in part], [tokens[x[4]:x[5]] for x in part]
        score, stop = align(a, b)
        good = [k for k, x in enumerate(part) if score[k] >= threshold * MATCH * x[0]]
        if not good:
            continue
        # the same alignment from behind tells where it begins
        _, back = align([a[k][::-1] for k in good], [b[k][:stop[k]][::-1] for k in good])
        for k, r in zip(good, back, strict=True):
            m, _, d, i, begin, _ = part[k]
            own = (float(score[k]) / (MATCH * m), int(begin + stop[k] - r - ends[d]), int(begin + stop[k] - ends[d]))
            if own[0] > found[d].get(i, (0,))[0]:
                found[d][i] = own
    return [[(items.ids[i], *v) for i, v in sorted(own.items())] for own in found]


HITS = "array<struct<item_id:bigint,score:double,begin_word:bigint,end_word:bigint>>"


def leaks(items: Items, threshold: float, text: str = "text", at_once: int = 1 << 20) -> Column:
    """The leaks of a block's items in a text."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("begin_word", pa.int64()), ("end_word", pa.int64())]))

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        out = [own for part in _chunks(texts, at_once) for own in _leaks(part, items, threshold)]
        return pa.array([[dict(zip(("item_id", "score", "begin_word", "end_word"), x, strict=True)) for x in own] for own in out], kind)

    return hits(text_bytes(text))


def seeds(docs: DataFrame, benchmark: DataFrame, n: int = 3, block_bytes: int = 4 << 20) -> Iterator[Items]:
    """The test items and their seeds, block by block of about block_bytes of text."""
    small_batches(docs.sparkSession)
    bench = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        own = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        items = block([(r.item_id, r.text.encode()) for r in own], n)
        if len(items.grams):
            yield items


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, **params) -> DataFrame:
    """doc_id, item_id, score (1: all words in order), begin_word, end_word:
    the best passage of each item that a document has."""
    own, found = docs.select("doc_id", "text"), None
    for items in seeds(docs, benchmark, **params):
        hit = own.select("doc_id", F.explode(leaks(items, threshold)).alias("h")).select("doc_id", "h.*")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, score double, begin_word bigint, end_word bigint")
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, **params) -> DataFrame:
    """The rows of docs without a leak, as they are."""
    for items in seeds(docs, benchmark, **params):
        docs = docs.withColumn("__leaks", leaks(items, threshold)).filter(F.size("__leaks") == 0).drop("__leaks")
    return docs
