"""A vocabulary made from the texts is made once, not again for each step that reads it."""

import pytest

from bibliomill.functions import automaton
from bibliomill.operators import search as S
from bibliomill.plans import load_queries
from bibliomill.plans.registry import Tables


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["txt_04_every_word", "ali_16_entity_counts"])
def test_words_of_the_texts_are_written_before_they_are_searched(spark, tmp_path, monkeypatch, name):
    asked = []
    plain = S.page_hits
    monkeypatch.setattr(S, "page_hits", lambda pages, terms, *rest: asked.append(plan(terms)) or plain(pages, terms, *rest))
    rows = [(i, f"Some words number{i % 3} of a text and more", "en", f"src{i % 2}", 30) for i in range(6)]
    spark.createDataFrame([*rows, (9, None, "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = load_queries()[name].plan(Tables(spark, str(tmp_path))).collect()
    assert got and len(asked) == 1 and "Aggregate" not in asked[0]


def test_terms_are_made_distinct_once(spark, monkeypatch):
    made = []
    plain = automaton.cut_lineage
    monkeypatch.setattr(automaton, "cut_lineage", lambda df, purpose: made.append(purpose) or plain(df, purpose))
    terms = spark.createDataFrame([("ab",), ("ab",), ("",), ("c",)], "term string")
    rows = spark.createDataFrame([(1, "abcab")], "doc_id long, text string")
    got = automaton.located(rows, "text", terms)
    assert sorted((r["_term"], r["_n"], r["_first"]) for r in got.collect()) == [("ab", 2, 0), ("c", 1, 2)]
    assert made == ["vocabulary"]
