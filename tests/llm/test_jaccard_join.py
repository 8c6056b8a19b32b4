"""The n-gram Jaccard join against all pairs compared one by one."""

import random
import re

import pyarrow as pa
import pytest

from bibliomill.llm import jaccard, linking

SCHEMA = "doc_id long, text string, node string, sig long, ROW int"


def brute(rows, least=80, n=5):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and 100 * shared >= least * (len(a) + len(sets[j]) - shared):
                label[root(i)] = root(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in members[root(i)] if rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def got(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    report = jaccard.join_report(docs, **more)
    assert report.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in report.collect()), key=repr)


def copies(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, f"new{rng.randrange(10**6)}")
    return out


@pytest.mark.parametrize("seed,least", [(1, 80), (3, 70)])
def test_links_near_the_limit_are_those_of_all_pairs(spark, seed, least):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for base in range(30):
        size = rng.choice([1, 3, 4, 5, 6, 8, 9, 12, 15, 20, 33, 60, 120, 260])
        words = [f"w{rng.randrange(4000)}" for _ in range(size)]
        if base % 3 == 0:
            words = words + passage
        for _ in range(rng.randrange(1, 7)):
            rows.append((len(rows), " ".join(copies(rng, words, rng.randrange(0, 1 + max(1, len(words) // 14))) if len(words) > 5 else words)))
    # few different words: many sets share most of their n-grams
    for _ in range(30):
        rows.append((len(rows), " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 24)))))
    rng.shuffle(rows)
    assert got(spark, rows, least=least) == brute(rows, least)


def test_odd_rows(spark):
    long_text = " ".join(f"l{i % 3000}" for i in range(30_000))
    rows = [
        (None, "A b C d e"), (3, "a  B\tc d E"), (2, None), (1, ""), (None, " \n"), (4, "one two"), (5, "ONE\x0btwo"), (5, "ONE\x0btwo"), (6, "two one"),
        (7, "É b c d e"), (8, "é b c d e"), (9, "a b c d e f"), (10, long_text), (11, long_text + " end"), (None, "alone in here"),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_sets_in_one_segment_still_find_each_other(spark):
    # sizes at which a few members often share a segment, so that empty ones are looked up
    rng = random.Random(9)
    rows = []
    for _ in range(60):
        words = [f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 17))]
        rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join([*words, "more"])))
    assert got(spark, rows) == brute(rows)


def test_pairs_of_a_group_of_near_copies_do_not_grow_with_its_square(spark, monkeypatch):
    compared = []
    plain = linking.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(linking, "verified", counted)
    made = {}
    for n in (80, 320):
        rng = random.Random(n)
        words = [f"w{i}" for i in range(120)]
        rows = [(i, " ".join(copies(rng, words, 2))) for i in range(n)]
        compared.clear()
        components = {r[2] for r in got(spark, rows)}
        made[n] = sum(compared)
        assert len(components) == len({r[2] for r in brute(rows)}) if n == 80 else len(components) < 5
    assert made[320] < 8 * made[80] and made[320] < 12 * 320


def test_segments_cover_every_alike_pair():
    for low, high, segments in jaccard.bands(80)[:20]:
        assert segments > jaccard.difference(high, high * 100 // 80)
    assert [b[0] for b in jaccard.bands(80)[1:]] == [b[1] + 1 for b in jaccard.bands(80)[:-1]]


def test_words_hashed_at_once_are_those_of_split():
    rng = random.Random(5)
    alphabet = ["a", "A", "b", " ", "\t", "\x0b", "\x1c", "\u00a0", "\u00c9", "\u00e9", "\u4e2d", "\0", "word"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "x" * 255, "x" * 256, "x" * 257, "x" * 1000 + "y", "x" * 1000 + "z", "end", "a" * 8, "a" * 7 + "\0", "a" * 7]
    names = {}
    for column in (pa.array(texts), pa.array(["cut off", *texts, None, "too"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        hashes, first = jaccard.hashed_words(column)
        for text, lo, hi in zip(texts, first[:-1], first[1:]):
            want = (text or "").encode().lower().split()
            assert len(want) == hi - lo
            for word, value in zip(want, hashes[lo:hi]):
                assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_keys_that_bring_the_same_sets_together_are_one_row(spark, monkeypatch):
    made = []
    plain = jaccard.connected
    monkeypatch.setattr(jaccard, "connected", lambda rows, *rest, **more: made.append(rows.count()) or plain(rows, *rest, **more))
    words = [f"w{i}" for i in range(500)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (2, " ".join([*words, "END"])), (3, "another text of its own")]
    assert got(spark, rows) == brute(rows)
    # some hundred segments in common
    assert made[0] < 80
