"""Each stage against a brute-force version on what the stage before it kept."""

import random

import pytest

import corpus_pipeline as cp
from gemstats.llm import quality
from gemstats.llm.common import fold, table
from tests.llm import test_decontaminate, test_exact_dedup, test_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, say(25)) for i in range(12)]
    texts = [say(rng.choice([5, 40, 120, 400])) for _ in range(150)]
    texts += [t.replace(" ", "\n", 3) + " " for t in texts[:25]]  # exact but for white space
    texts += [" ".join([*t.split()[:-1], "changed"]) for t in texts[25:60]]  # one word changed
    texts += [f"{say(60)} {rng.choice(items)[1]} {say(30)}" for _ in range(20)]
    texts += [" ".join(f"{w}###" for w in say(50).split()) for _ in range(60)]  # junk
    texts += ["", None, " \n", say(3000)]
    rng.shuffle(texts)
    docs = [(i * 7 % 1009, t, "en", None if i % 13 == 0 else f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(d, 0 if t and "###" in t else 1, 0) for d, t, *_ in docs if t and d % 10 < 7]
    return docs, labels, items


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    docs, labels, items = corpus()
    path = str(tmp_path_factory.mktemp("sf"))
    frames = {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
              "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (items, "item_id long, text string")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


def by_id(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_stages_match_brute_force(spark, sf_dir):
    docs, stages = table(spark, sf_dir, "documents"), dict(cp.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "simhash", "decontaminate", "mixing"]
    before = by_id(docs)

    good = stages["quality"](spark, docs, sf_dir)
    assert good.columns == COLUMNS
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality as label")
    scored = {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels).collect()}
    after = by_id(good)
    assert after == {d: v for d, v in before.items() if scored[d]}
    held = {r.doc_id for r in docs.filter(fold("doc_id", 4) == 2).collect()}
    junk = {d for d, v in before.items() if v[1] and "###" in v[1]}
    plain = {d for d, v in before.items() if v[1] and len(v[1].split()) >= 5} - junk
    assert len(junk & held) > 5 and not junk & set(after) and plain <= set(after)

    before, exact = after, stages["exact_dedup"](spark, good, sf_dir)
    assert exact.columns == COLUMNS
    kept = {r[0] for r in test_exact_dedup.brute([(d, v[1]) for d, v in before.items()]) if r[3]}
    after = by_id(exact)
    assert after == {d: before[d] for d in kept} and len(after) < len(before)

    before, near = after, stages["simhash"](spark, exact, sf_dir)
    assert near.columns == COLUMNS
    kept = {r[2] for r in test_simhash.brute([(d, v[1]) for d, v in before.items()])}
    after = by_id(near)
    assert after == {d: before[d] for d in kept} and len(after) < len(before)

    before, clean = after, stages["decontaminate"](spark, near, sf_dir)
    assert clean.columns == COLUMNS
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    leaked = {d for d, _ in test_decontaminate.brute([(d, v[1]) for d, v in before.items()], items)}
    after = by_id(clean)
    assert leaked and after == {d: v for d, v in before.items() if d not in leaked}

    mixed = stages["mixing"](spark, clean, sf_dir).collect()
    size = {d: len((v[1] or "").encode().split()) for d, v in after.items()}
    sums, takes, targets = {}, {}, {}
    for d, v in after.items():
        sums[v[3]] = sums.get(v[3], 0) + size[d]
    for r in mixed:
        assert tuple(r[c] for c in COLUMNS) == after[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sums[r.source]
        assert 1 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        takes[r.source] = takes.get(r.source, 0) + r.taken
        targets[r.source] = r.target
    assert sum(targets.values()) == pytest.approx(sum(sums.values()))
    largest = max(size.values())
    assert all(abs(takes[s] - targets[s]) <= largest / 2 + 1 for s in targets)

    whole = {(r.doc_id, r.taken) for r in cp.run(spark, sf_dir).collect()}
    assert whole == {(r.doc_id, r.taken) for r in mixed}


def test_empty_documents(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, sf_dir, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
