"""Redaction of a corpus and the check for what is left."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliomill.functions.dims import SMALL
from bibliomill.operators.search import contained_terms

# Private-use characters stand for protected tokens while the rules run.
_GUARD = "\U000f0000"


def _masked(text: Column, protected: Sequence[str], back: bool = False) -> Column:
    for i, token in enumerate(protected):
        guard = f"{_GUARD}{i}{_GUARD}"
        a, b = (guard, token) if back else (token, guard)
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def redacted(text: Column, rules: Sequence[tuple[str, str]], protected: Sequence[str] = ()) -> Column:
    """Literal replacements in the given order; protected tokens come out unchanged."""
    out = _masked(text, protected)
    for old, new in rules:
        out = F.replace(out, F.lit(old), F.lit(new))
    return _masked(out, protected, back=True)


def redact(docs: DataFrame, rules: DataFrame, protected: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Apply ``rules(rank, old, new)``, in rank order, to every document.

    Every rule sees what the ones before it have written, so each text takes all of them in
    turn; the ordered list is a setting read once and travels with the plan, whatever its length.
    """
    pairs = [(r["old"], r["new"]) for r in rules.filter("old <> ''").orderBy("rank").select("old", F.coalesce("new", F.lit("")).alias("new")).collect()]
    if len(pairs) <= SMALL:
        return docs.withColumn(text, redacted(F.col(text), pairs, protected))
    # a long list is a constant array walked inside the row, not an expression per rule
    ordered = F.from_json(F.lit(json.dumps([{"old": a, "new": b} for a, b in pairs], ensure_ascii=False)), "array<struct<old:string,new:string>>")
    done = F.aggregate(ordered, _masked(F.col(text), protected), lambda out, r: F.replace(out, r["old"], r["new"]))
    return docs.withColumn(text, _masked(done, protected, back=True))


def leaks(docs: DataFrame, words: DataFrame, protected: Sequence[str] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """First listed word (``rank, word``) still found in each document, protected tokens
    aside; documents without any give no row."""
    d = docs.select(key, _masked(F.col(text), protected).alias("_t"))
    found = contained_terms(d, [key], "_t", words.select("word", "rank"), "word")
    return found.groupBy(key).agg(F.min_by("word", "rank").alias("word"))
