"""Near duplicates by MinHash: groups of many near copies, and recall at the limit."""

import random

import pytest

from bibliomill.llm import linking, minhash

SF = "/root/testdata/sf0.001"


def near(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def links(rows):
    sets = [frozenset(minhash.shingles(t or "").tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))}


@pytest.mark.parametrize("n", [60, 240])
def test_pairs_of_a_group_grow_with_its_size(spark, monkeypatch, n):
    made = []
    plain = linking.verified
    monkeypatch.setattr(linking, "verified", lambda pairs, *rest: made.append(pairs.count()) or plain(pairs, *rest))
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, near(rng, words, 2)) for i in range(n)] + [(n + i, near(rng, words, 60)) for i in range(20)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == links(rows)
    assert sum(made) <= 16 * n


def test_a_crowd_that_shares_a_passage_is_compared_by_rare_shingles(spark, monkeypatch):
    made = []
    plain = linking.verified
    monkeypatch.setattr(linking, "verified", lambda pairs, *rest: made.append(pairs.count()) or plain(pairs, *rest))
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(130):
        own = " ".join(f"o{rng.randrange(10**6)}" for _ in range(30))
        rows.append((2 * i, f"{own} {passage}"))
        if i % 10 == 0:
            rows.append((2 * i + 1, f"{own} {passage} end"))
    monkeypatch.setattr(linking, "FEW", 4)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == links(rows)
    assert sum(made) < 8 * len(rows)


def test_a_crowd_without_any_link(spark, monkeypatch):
    monkeypatch.setattr(linking, "FEW", 1)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(20)) + " " + passage) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == links(rows)
