"""Registered queries against plain Python over the same whole tables."""

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bibliomill.llm import html, language, licenses, minhash, packing, quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall(), key=repr)


def test_language_on_held_out_texts(spark, documents):
    rows = rows_of(spark, "op1_language_id")
    assert len(rows) == len(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_fingerprints(spark, documents):
    rows = {r.doc_id: r for r in rows_of(spark, "op2_minhash")}
    ids = sorted(documents, reverse=True)
    hashes = minhash.permutations()
    sig = {i: minhash.signature(minhash.shingles(documents[i].text or ""), hashes) for i in ids}
    for i, following in zip(ids, ids[1:] + ids[:1]):
        text, other = documents[i].text or "", documents[following].text or ""
        cut = len(text) // 3
        new = text[: len(text) - cut] + other[:cut]
        new_sig = minhash.signature(minhash.shingles(new), hashes)
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (minhash.as_text(sig[i]), minhash.as_text(new_sig))
        assert (r.near_edited, r.near_next) == (float((sig[i] == new_sig).mean()), float((sig[i] == sig[following]).mean()))


def test_near_duplicates_by_minhash(spark, documents):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    sets = {i: set(minhash.shingles(d.text or "").tolist()) for i, d in documents.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert got == components(sorted(documents), alike)


def test_main_text(spark):
    from html import unescape

    rows = {r.page_id: r.text for r in rows_of(spark, "op3_main_text")}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert rows[page.page_id] == "\n\n".join(p for p in parts if p)


def test_practice_pages_that_were_not_learned():
    labeller = html.train([], practice=600)
    rng = np.random.default_rng(77)
    right = total = 0
    for _ in range(100):
        page, gold = html.practice_page(rng, "alpha beta gamma delta epsilon zeta eta theta".split() * 5)
        if page:
            right += int(((labeller.scores([page])[:, 0] >= 0.5) == np.array(gold)).sum())
            total += len(gold)
    assert right >= 0.97 * total


def test_quality_counts(spark, documents):
    for r in rows_of(spark, "op5_quality_rules"):
        text = documents[r.doc_id].text or ""
        words = WORD.findall(text)
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        repeated = {p for places in windows.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_verdicts_follow_the_labels(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [r for r in labels if r.quality == 1 and not rows[r.doc_id].base_failed]
    bad = [r for r in labels if r.quality == 0]
    assert sum(rows[r.doc_id].kept for r in good) >= 0.98 * len(good)
    assert sum(not rows[r.doc_id].kept for r in bad) >= 0.9 * len(bad)


def test_simhash(spark, documents):
    from xxhash import xxh64_intdigest

    rows = {r.doc_id: r for r in rows_of(spark, "op7_simhash")}
    prints = {}
    for i, d in documents.items():
        words = (d.text or "").encode().lower().split()
        parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
        values = [xxh64_intdigest(p, 42) for p in parts]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))
        assert rows[i].fingerprint == f"{prints[i]:016x}"
    want = components(sorted(documents), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: r.component_id for i, r in rows.items()} == want


def test_licenses(spark, documents):
    lines = {k: v for k, v in licenses.TEMPLATES.items() if k in ("MIT/line", "Apache-2.0/line", "GPL-3.0/line", "CC-BY-NC-4.0/line")}
    for r in rows_of(spark, "op8_license_scan"):
        text = documents[r.doc_id].text or ""
        want = sorted((m.start(), m.end() - 1, k) for k, v in lines.items() for m in re.finditer(re.escape(v), text))
        assert r.spans == ",".join(f"{k}:{a}:{b}:1.000" for a, b, k in want) and r.n_matches == len(want)


def test_packing(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op9_best_fit_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, d in documents.items():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        at = 0
        for n, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (r.length == 2048 or n == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 2


def test_packed_ids_come_back(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.packed_pieces(docs, keep_ids=True)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * r.length <= 4 * 2048
    chunks = packing.Chunks(packing.vocabulary_path())
    joined = defaultdict(dict)
    for r in packed.collect():
        joined[r.doc_id][r.piece] = bytes(r.ids)
    for i, d in documents.items():
        assert b"".join(v for _, v in sorted(joined[i].items())) == chunks.ids(d.text or "") + bytes(4)


def test_mixture(spark, documents):
    rows = {r.doc_id: r for r in rows_of(spark, "op10_source_mix")}
    assert rows == {r.doc_id: r for r in rows_of(spark, "op10_source_mix")}
    size = {i: len(WORD.findall(d.text or "")) for i, d in documents.items()}
    by_source = Counter()
    for i, d in documents.items():
        by_source[d.source] += size[i]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, held = sum(size.values()), {}, set()
    while True:
        left = total - sum(3 * by_source[s] for s in held)
        share = sum(weight[s] for s in order if s not in held)
        target = {s: 3 * by_source[s] if s in held else left * weight[s] / share for s in order}
        over = {s for s in order if target[s] > 3 * by_source[s] and s not in held}
        if not over:
            break
        held |= over
    taken = Counter()
    for i, r in rows.items():
        source = documents[i].source
        assert (r.size, r.source_size) == (size[i], by_source[source]) and r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 64


def test_language_buckets_do_not_depend_on_neighbours():
    one, owner = language.buckets_of(["haus", "wald"])
    assert sorted(one[owner == 0]) == sorted(language.buckets_of(["haus"])[0])


def test_repeated_positions_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, 3, int(rng.integers(0, 60)))
        windows = defaultdict(list)
        for i in range(len(ids) - 7):
            windows[tuple(ids[i : i + 8])].append(i)
        want = {p for v in windows.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
        assert quality.repeated_positions(ids) == len(want)
