"""The prefix trie against one that is built node by node."""

import hashlib
import random
import zlib

import pytest

from bibliomill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, POS int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = {}, {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - int(c / 100) * 0 - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + seq[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in below)
    return sorted(
        (
            (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
            for n, m in members.items()
        ),
        key=repr,
    )


def got(spark, rows, band=trie.BAND):
    frame = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA).repartition(3)
    report = trie.trie_report(frame, band)
    assert report.columns == COLUMNS
    return sorted((tuple(r) for r in report.collect()), key=repr)


@pytest.mark.parametrize("band", [2, 3, 8])
def test_same_nodes_for_any_height_of_bands(spark, band):
    rng = random.Random(band)
    rows = []
    for conv in rng.sample(range(0, 450), 120):
        for turn in range(rng.choice([0, 1, 2, 4, 6, 9, 20])):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "", "what now", "längerer Text 字"]) + ("" if rng.random() < 0.8 else str(rng.random()))))
    rng.shuffle(rows)
    assert got(spark, rows, band) == brute(rows)


def test_one_conversation_of_many_turns(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = [(200, i, "user", f"t{i % 5}") for i in range(300)] + [(c, i, "user", f"t{i % 5}") for c in (201, 202, 203) for i in range(150 + c % 3)]
    assert got(spark, rows, 4) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "lost"), (1, None, None, None), (1, None, "user", "b"), (1, 3, "user", "b"), (1, 3, "user", "b"), (1, 3, None, "a"), (1, -2, "x", ""),
        (100, 0, "user", "long " * 5000), (105, 0, "user", "other"), (107, 0, "user", "other"), (-5, 1, "u", "t"), (-105, 1, "u", "t"), (-100, 1, "u", "s"), (-100, 2, "u", "s2"),
        (7, 1, "us", "er"), (8, 1, "use", "r"), (300, 1, "us", "er"), (301, 2, "a", "b"),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_ids_of_a_hot_node_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(5, 1400)]
    assert got(spark, rows) == brute(rows)
