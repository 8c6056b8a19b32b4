"""Whole jobs where a part was left out before."""

import random

import numpy as np
import pytest

import corpus_pipeline
from bibliomill.llm import html, licenses, packing

NEAR_DEDUP = dict(corpus_pipeline.STAGES)["near_dedup"]


def test_near_dedup_finds_copies_with_changed_words(spark):
    rng = random.Random(3)
    texts, kept = [], []
    for n in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(30 + 5 * n)]
        changes = [words]
        for k in (1, 2, 4, 8, 16):
            new = list(words)
            for at in rng.sample(range(len(words)), k):
                new[at] = f"x{rng.randrange(10**6)}"
            changes.append(new)
        changes.append([w.upper() for w in words])
        group = [" ".join(c) for c in changes]
        sets = [{tuple(c[i : i + 5]) for i in range(len(c) - 4)} for c in ([w.lower() for w in c] for c in changes)]
        root = list(range(len(group)))
        for _ in group:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if len(a & b) >= 0.8 * len(a | b):
                        root[i] = root[j] = min(root[i], root[j])
        kept += [len(texts) + i for i in range(len(group)) if root[i] == i]
        texts += group
    assert len(kept) < len(texts) - 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in NEAR_DEDUP(spark, df, "").collect()) == kept


def test_every_one_word_edit_of_a_short_licence_line():
    index = licenses.Index(licenses.TEMPLATES, licenses.GRAM, licenses.WINDOW)
    checked = 0
    for t, words in enumerate(w.decode() for ws in index.words for w in [b" ".join(ws)]):
        words = words.split()
        if len(words) >= 25:
            continue
        edits = [words] + [words[:i] + new + words[i + cut :] for i in range(len(words)) for new, cut in (([], 1), (["zebra"], 1), (["zebra"], 0))]
        for edit in edits:
            ids = np.array([index.number.get(w.encode(), 0) for w in edit])
            matches = {u: licenses.align(ids, index.ids[u], 0, len(ids) + len(index.ids[u]))[0] for u in range(len(index.ids))}
            if matches[t] < licenses.COVERAGE * len(words):
                continue
            checked += 1
            found = licenses.find(f"lorem ipsum. {' '.join(edit)} dolor sit", index)
            assert any(name == index.names[t] or matches[index.names.index(name)] >= matches[t] for name, *_ in found), edit
    assert checked > 100
    (name, start, end, share), = licenses.find("Released under a MIT License.", index)
    assert (name, start, end, share) == ("MIT/line", 0, 28, 0.8)


@pytest.mark.parametrize("text", ["ab <|endoftext|> cd", "<|endoftext|>", "<|endoftext|><|endoftext|>x  y", "a  <|endoftext|>\n\n b <|endoftext", "<|ENDOFTEXT|> 's"])
def test_added_tokens_have_their_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Chunks(packing.vocabulary_path()).ids(text), "<u4").tolist() == want


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<html><head><title>t</title><meta x><body><p>one</p>", ["one"]),
        ("<html><head><title>t</title><style>a</style><p>one</p>two", ["one", "two"]),
        ("<html><head><title>t</title>\n one <p>two", ["one", "two"]),
        ("<head><title>t</title><script>x</script> </head><p>one</p>", ["one"]),
        *[(f"<p>one</p><{tag}/><p>two</p><{tag}>x</{tag}><p>three</p>", ["one", "two", "three"]) for tag in ("svg", "iframe")],
        *[(f"<p>one</p><{tag} a='>'><p>two</p>", ["one", "two"]) for tag in ("select", "noscript", "object", "textarea", "iframe", "svg", "template", "title")],
        *[(f"<p>one</p><{tag}><p>two</p><{tag}>x</{tag}><p>three</p>", ["one", "two", "three"]) for tag in ("select", "noscript", "object", "textarea")],
        ("<svg><svg>x</svg>y</svg><p>one</p>", ["one"]),
        ("<p>area <math><mi>r</mi><mn>2</mn></math> and <math/>more</p>", ["area r2 and more"]),
        ("<p>one</p><script>var x = '<p>y</p>'", ["one"]),
    ],
)
def test_elements_without_end_swallow_no_text(page, texts):
    assert [b.text for b in html.blocks(page)] == texts
