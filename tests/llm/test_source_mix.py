"""The mix against plain Python: blocks, shard draws, permutations, and the texts it writes."""

import os
import re
from collections import Counter, defaultdict

import pytest

from bibliomill.llm import mixing, queries
from bibliomill.llm.common import WORD

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hashed(*values) -> int:
    """Spark's hash of several values: each one seeded by the hash of those before it."""
    xxhash = pytest.importorskip("xxhash")
    h = 42
    for kind, v in values:
        h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else v.to_bytes({"i": 4, "l": 8}[kind], "little", signed=True), h)
    return signed(h)


def permuted(x: int, n: int, key: tuple, order: range) -> int:
    for r in order:
        partner = (hashed(key, ("i", r)) % n - x) % n
        if hashed(key, ("i", r), ("l", max(x, partner))) & 1:
            x = partner
    return x


def expected(docs, per_source):
    """taken, slots and first place of each document, slot by slot."""
    names = sorted(per_source)
    source_slots = {}
    for name in names:
        size, target = per_source[name]
        blocks = -(-size // mixing.BLOCK_WORDS)
        source_slots[name] = (blocks, min(round(target * blocks / size), 3 * blocks))
    all_slots = sum(n for _, n in source_slots.values())
    counts, slot = defaultdict(Counter), 0
    for name in names:
        for _ in range(source_slots[name][1]):
            place = permuted(slot, all_slots, ("i", mixing.SEED), range(mixing.ROUNDS, 0, -1))
            counts[place // mixing.SHARD_SLOTS][name] += 1
            slot += 1
    owners = {}  # the document of every word of a source, in block order
    for name in names:
        order = []
        for d in docs:
            if d.source == name:
                text = d.text or ""
                digest = hashed(("s", text)) if d.text is not None else 42
                place = (hashed(("l", d.doc_id), ("l", digest)) if d.text is not None else hashed(("l", d.doc_id))) % mixing.SLICES
                order.append((place, d.doc_id, digest, len(re.findall(WORD, text))))
        owners[name] = [doc for _, doc, _, size in sorted(order) for _ in range(size)]
    taken, used, first, began = Counter(), Counter(), {}, Counter()
    for shard in sorted(counts):
        held, before = sum(counts[shard].values()), 0
        for name in names:
            blocks = source_slots[name][0]
            for i in range(counts[shard][name]):
                k = began[name] + i
                key = ("l", hashed(("i", mixing.SEED), ("s", "=" + name), ("l", k // blocks)))
                block = permuted(k % blocks, blocks, key, range(1, mixing.ROUNDS + 1))
                at = permuted(before + i, held, ("l", hashed(("i", mixing.SEED), ("l", shard))), range(1, mixing.PLACE_ROUNDS + 1))
                words = owners[name][block * mixing.BLOCK_WORDS : (block + 1) * mixing.BLOCK_WORDS]
                for doc, n in Counter(words).items():
                    taken[doc] += n
                    used[doc] += 1
                    place = shard * mixing.SHARD_SLOTS + at
                    first[doc] = min(first.get(doc, place), place)
            began[name] += counts[shard][name]
            before += counts[shard][name]
    return {d.doc_id: (taken[d.doc_id], used[d.doc_id], first.get(d.doc_id)) for d in docs}


@pytest.mark.parametrize("shard_slots", [mixing.SHARD_SLOTS, 64])
def test_blocks_draws_and_permutations(spark, monkeypatch, shard_slots):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", shard_slots)
    monkeypatch.setattr(mixing, "SHARD_RANGE", 5)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    source = {d.doc_id: d.source for d in docs}
    rows = queries.QUERIES["op10_source_mix"](spark, SF).collect()
    want = expected(docs, {source[r.doc_id]: (r.source_size, r.target) for r in rows})
    assert {r.doc_id: (r.taken, r.slots, r.first_place) for r in rows} == want
    assert all(r.first_shard == (None if r.first_place is None else r.first_place // shard_slots) for r in rows)


def test_the_shards_reach_the_result(spark):
    df = queries.QUERIES["op10_source_mix"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "shard" in plan and "place" in plan


def test_mixed_rows_are_parts_of_their_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {d.doc_id: d for d in df.collect()}
    taken = {r.doc_id: r.taken for r in mixing.mix_report(df).collect()}
    rows = mixing.mixed_documents(df, places=True).collect()
    words = Counter()
    for r in rows:
        assert r.text in docs[r.doc_id].text
        words[r.doc_id] += len(re.findall(WORD, r.text))
    assert {i: words[i] for i in docs} == taken
    # the first so many times take a document whole and leave its text as it is
    again = Counter((r.doc_id, r.mix_copy) for r in rows if r.text == docs[r.doc_id].text)
    assert again and set(again.values()) == {1}
    by_copy = defaultdict(list)
    for r in rows:
        by_copy[r.doc_id, r.mix_copy].append(r.text)
    for (doc, _), parts in by_copy.items():
        assert sum(len(p) for p in parts) <= len(docs[doc].text)
    assert mixing.mixed_documents(df).columns == df.columns


def test_white_space_inside_a_stretch_stays(spark):
    text = "\n  " + "".join(f"w{i}{' ' if i % 7 else chr(10) * 2}" for i in range(400)) + "\t"
    other = " ".join(f"x{i}" for i in range(4000))
    df = spark.createDataFrame([(1, text, "a"), (2, other, "b"), (3, other, "c")], "doc_id long, text string, source string")
    rows = mixing.mixed_documents(df).collect()
    assert all(r.text in {1: text, 2: other, 3: other}[r.doc_id] for r in rows)
    assert any("\n\n" in r.text for r in rows if r.doc_id == 1)
