"""The prefix trie against one built conversation by conversation."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from gemstats.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        batch = c - (c % 20 if c >= 0 else -(-c % 20))
        seqs[c] = tuple(own.get(batch, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
        ends = ",".join(str(c) for c in sorted(members[node]) if len(seqs[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
                    len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie(df):
    return sorted((tuple(r) for r in prefix_trie(df).select(*COLUMNS).collect()), key=lambda r: r[:2])


def test_random_conversations_with_ties_nulls_and_gaps(spark):
    rnd = random.Random(3)
    rows = []
    for c in rnd.sample(range(-45, 300), 150):
        for i in range(rnd.randint(1, 6)):
            rows.append((c, rnd.choice([None, i, i, 2]), rnd.choice(["user", "bot", None]), rnd.choice(["x y", "z", None, ""])))
    rows += [(None, 1, "user", "x")] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert trie(df) == by_hand(rows)


def test_one_conversation_with_a_third_of_all_rows_goes_over_many_ranges(spark):
    rows = [(77, i, "user", f"turn {i % 3}") for i in range(200)] + [(77, None, "user", "again")] * 60
    rows += [(c, i, "user", "hello there") for c in range(100, 200) for i in range(2)]
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(4)) == by_hand(rows)


def test_many_equal_conversations_collapse(spark):
    rows = [(20 * c, i, "user", f"same {i}") for c in range(300) for i in range(3)]
    rows += [(20 * c, 3, "user", "one more") for c in range(5)]
    assert trie(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_a_conversation_without_turns_ends_at_the_root(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(c, 0, "user", "gone, as there is no first conversation")]
    out = trie(spark.createDataFrame(rows, SCHEMA))
    assert out == by_hand(rows)
    assert out[0][1] == 0 and out[0][-1] == hashlib.sha256(str(c).encode()).hexdigest()


def test_empty_table_and_extra_columns(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    rows = [(c, i, "user", f"{'a ' * 3000}{c % 3}") for c in range(40, 50) for i in range(2)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", id long, part string, depth long")
    assert trie(df) == by_hand(rows)
