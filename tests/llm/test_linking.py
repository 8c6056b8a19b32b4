"""What the rounds compare and write."""

import random

from bibliomill.llm import jaccard, linking, minhash, simhash


def words(rng, n):
    return " ".join(f"o{rng.randrange(10**6)}" for _ in range(n))


def crowds(rng, size):
    """Two crowds that share a passage each; their i-th texts have a few words in common."""
    rows = []
    for i in range(size):
        both = " ".join(f"b{i}x{j}" for j in range(8))
        for side in "pq":
            passage = " ".join(f"{side}{j}" for j in range(60))
            rows.append((len(rows), f"{words(rng, 14)} {both} {passage}"))
    return rows


def band_keys(text):
    sig = minhash.signature(minhash.shingles(text), minhash.permutations())
    width = minhash.PERMUTATIONS // minhash.BANDS
    return {(i, sig[i : i + width].tobytes()) for i in range(0, minhash.PERMUTATIONS, width)}


def test_texts_without_a_common_band_are_never_compared(spark, monkeypatch):
    made, asked = [], []
    plain, rare = linking.verified, linking.rare_members
    monkeypatch.setattr(linking, "FEW", 0)
    monkeypatch.setattr(linking, "verified", lambda pairs, *rest: made.extend((r.a, r.b) for r in pairs.collect()) or plain(pairs, *rest))
    monkeypatch.setattr(minhash, "rare_members", lambda *rest: asked.append(1) or rare(*rest))
    rows = crowds(random.Random(2), 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    node = {r.node: r.text for r in docs.select("text", minhash.signed(docs["text"])["class"].alias("node")).collect()}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: i for i, _ in rows} and asked and made
    assert all(band_keys(node[a]) & band_keys(node[b]) for a, b in made)


def test_rounds_write_the_rows_of_a_group_once(spark, monkeypatch):
    written = {}
    plain = linking.cut_lineage

    def counted(df, purpose):
        out = plain(df, purpose)
        written.setdefault(purpose, []).append(out.count())
        return out

    monkeypatch.setattr(linking, "cut_lineage", counted)
    monkeypatch.setattr(linking, "FEW", 1)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(14 if i % 5 == 0 else 3):
            text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(150 + i, t) for i, t in crowds(rng, 15)]
    minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    met = written["labelled"][0]
    assert len(written["labelled"]) > 1 and all(n <= met for n in written["labelled"])
    assert "rows" not in written and all(n < met for n in written.get("told", []))


def test_told_texts_of_a_crowd_are_found_by_rare_members(spark, monkeypatch):
    # a set whose free segments suffice asks nobody; it is found by those that ask
    monkeypatch.setattr(linking, "FEW", 0)
    asked = []
    rare = linking.rare_members
    monkeypatch.setattr(jaccard, "rare_members", lambda *rest: asked.append(1) or rare(*rest))
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(25):
        own = words(rng, 20).split()
        for changes in (0, 1, 2, 3):
            text = [*own, *passage]
            for _ in range(changes):
                text[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    from test_jaccard_join import brute, got

    assert got(spark, rows) == brute(rows) and asked


def test_a_passage_too_long_for_rare_members_makes_no_pairs(spark, monkeypatch):
    # 56 shared n-grams of 74: not alike, but the rarest of a set reach into the passage
    made = []
    plain = linking.verified
    monkeypatch.setattr(linking, "verified", lambda pairs, *rest: made.append(pairs.count()) or plain(pairs, *rest))
    monkeypatch.setattr(linking, "FEW", 0)
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{words(rng, 9)} {passage}") for i in range(60)]
    from test_jaccard_join import brute, got

    assert got(spark, rows) == brute(rows)
    assert sum(made) <= 4 * len(rows)


def test_few_edges_are_joined_in_one_task_with_the_same_components(spark, monkeypatch):
    rng = random.Random(7)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "a long, b long").repartition(5)
    widths = []
    plain = simhash.cut_lineage
    monkeypatch.setattr(simhash, "cut_lineage", lambda df, purpose: widths.append(df.rdd.getNumPartitions()) or plain(df, purpose))
    found = {}
    for few in (0, 1000):
        monkeypatch.setattr(simhash, "FEW_EDGES", few)
        widths.clear()
        found[few] = sorted(map(tuple, simhash.components(edges).collect()))
    assert found[0] == found[1000] and found[0]
    assert set(widths[1:]) == {1}
