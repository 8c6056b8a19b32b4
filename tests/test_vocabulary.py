"""Vocabularies too large for an automaton: one scan, whatever the number of terms."""

import random

import numpy as np
import pyarrow as pa
import pytest

from bibliomill.functions import automaton
from bibliomill.operators import search as S

PAGES = "doc_id long, ord int, page long, text string"
SIZES = [1, 2, 3, 4, 6, 9]


def some_texts(rng, n):
    return ["".join(rng.choice("ab 吴é😀\n") for _ in range(rng.randrange(0, 60))) if rng.random() > 0.1 else None for _ in range(n)]


@pytest.mark.parametrize("room", [1 << 12, 32 << 20])
def test_a_vocabulary_of_many_shards_is_one_scan(spark, monkeypatch, room):
    rng = random.Random(7)
    pages = [(i, 0, 1, t) for i, t in enumerate(some_texts(rng, 120))] + [(200, 0, 1, "a" * 40), (201, 0, 1, "ab" * 30 + "吴" * 9)]
    cut = ["".join(rng.choice("ab 吴é😀\n") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    words = sorted({*cut, "aa", "aaa", "abab", "吴吴", "a" * 33, "never a term of a page at all", ""})
    monkeypatch.setattr(automaton, "SHARD_TERMS", 20)
    monkeypatch.setattr(automaton, "FILTER_BYTES", room)
    terms = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, pos int")
    hits = S.page_hits(spark.createDataFrame(pages, PAGES), terms, limit=1)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    want = sorted((d, w, t.count(w)) for d, _, _, t in pages for w in words if t and w and w in t)
    assert sorted(map(tuple, hits.select("doc_id", "term", "count").collect())) == want


@pytest.mark.parametrize("alike", [False, True])
def test_every_stretch_a_full_filter_lets_through(monkeypatch, alike):
    rng = random.Random(3)
    if alike:  # all stretches of one length have one hash
        monkeypatch.setattr(automaton._Hashes, "of", lambda self, at, size, whole: np.full(len(at), size, np.uint64))
    bits = np.full(1 << 12, 255, np.uint8)
    for chunk in (1, 25, 1 << 20):
        monkeypatch.setattr(automaton, "CHUNK_BYTES", chunk)
        texts = some_texts(rng, 12)
        for text, got in zip(texts, automaton._spots(pa.array(texts, pa.string()), bits, 15, SIZES).to_pylist()):
            text = text or ""
            parts = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
            want = {(p, text.count(p), text.find(p)) for p in parts if len(p.encode()) in SIZES}
            assert sorted((g["term"], g["n"], g["first"]) for g in got) == sorted(want)
