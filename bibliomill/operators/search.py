"""Term search over pages, with the name through which every hit came."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.functions import text as X
from bibliomill.functions.automaton import located
from bibliomill.functions.dims import SMALL, TERMS, broadcast_if_small, is_small, small_rows, struct_array
from bibliomill.functions.ranking import first_wins, top_per_key
from bibliomill.functions.variants import Variants
from bibliomill.session import cut_lineage


def contained_terms(
    rows: DataFrame,
    key: Sequence[str],
    text: str,
    terms: DataFrame,
    term: str = "term",
    limit: int = TERMS,
    counted: str | None = None,
) -> DataFrame:
    """Every row of ``rows`` once per term its text contains, with the term's columns, and with
    the number of its occurrences as the column ``counted``.

    The texts are read once and stay where they are.  Up to ``limit`` terms are a constant of
    the scan; a larger vocabulary is written once and found in one pass over the texts
    (``functions.automaton``), in a stream as in a batch, however many terms it has.  Only the
    terms found are joined with ``terms``.
    """
    terms = terms.filter(F.length(term) > 0)
    few = small_rows(terms, limit)
    if few is not None:
        table = struct_array(few, terms.schema)
        found = F.filter(table, lambda t: F.contains(F.col(text), t[term]))
        hits = rows.withColumn("_t", F.explode(found)).select(*rows.columns, "_t.*")
        return hits.withColumn(counted, X.count_literal(F.col(text), F.col(term))) if counted else hits
    terms = cut_lineage(terms, "terms")
    met = located(rows, text, terms, term)
    number = [F.col("_n").alias(counted)] if counted else []
    wanted = F.broadcast(terms) if is_small(terms) else terms.hint("shuffle_hash")
    joined = met.join(wanted, F.col("_term") == F.col(term))
    return joined.select(*rows.columns, *terms.columns, *number)


def documents_with_any(docs: DataFrame, terms: DataFrame, text: str = "text", limit: int = SMALL) -> DataFrame:
    """Coarse filter before pages are cut: documents containing one of few terms."""
    few = small_rows(terms.select("term").distinct(), limit)
    if few is None:
        return docs
    words = F.from_json(F.lit(json.dumps([r["term"] for r in few])), "array<string>")
    return docs.filter(F.exists(words, lambda w: F.contains(F.col(text), w)))


def page_hits(
    pages: DataFrame,
    terms: DataFrame,
    key: Sequence[str] = ("doc_id",),
    case_insensitive: bool = False,
    max_pages: int | None = None,
    with_snippet: bool = False,
    limit: int = TERMS,
) -> DataFrame:
    """One row per page and term that occurs on it, with the number of occurrences."""
    if max_pages is not None:
        pages = pages.filter(F.col("ord") < max_pages)
    if case_insensitive:
        pages = pages.withColumn("text", F.lower("text"))
        # terms that differ in case only are one term
        terms = first_wins(terms.withColumn("term", F.lower("term")), ["term"], ["pos"]).select(*terms.columns)
    hits = contained_terms(pages, [*key, "ord"], "text", terms, limit=limit, counted="count")
    if with_snippet:
        hits = hits.withColumn("snippet", X.snippet(F.col("text"), F.col("term")))
    return hits.drop("text")


def converted_hits(pages: DataFrame, originals: DataFrame, terms: DataFrame, variants: Variants) -> DataFrame:
    """Page hits in the originals of converted texts, each searched in its own script.

    ``pages(dir, name, ord, page, text)``; ``originals(dir, open_file, terms_to)`` says in which
    direction terms go for a file.  The terms are converted once per direction, before the
    search, and keep the term they were ``asked`` as.
    """
    wanted = None
    for direction in ("t2s", "s2t"):
        one = terms.withColumn("asked", F.col("term")).withColumn("term", variants.convert(F.col("term"), direction)).withColumn("_to", F.lit(direction))
        wanted = one if wanted is None else wanted.unionByName(one)
    opened = originals.select("dir", F.col("open_file").alias("name"), "terms_to").distinct()
    hits = page_hits(pages.join(broadcast_if_small(opened), ["dir", "name"]), wanted, key=("dir", "name", "terms_to"))
    return hits.where(F.col("_to") == F.col("terms_to")).drop("_to")


def first_page(hits: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """First page with a hit, pages before terms."""
    return hits.groupBy(*key).agg(
        F.min_by(F.struct("page", "term"), F.struct("ord", "pos")).alias("h")
    ).select(*key, F.col("h.page").alias("page"), F.col("h.term").alias("term"))


def loose_hits(pages: DataFrame, terms: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Hits found after all white space is taken out, with the true span of the first.

    ``start`` counts from 0 in the page as it is; ``span`` may be longer than the term.
    """
    squeezed = pages.withColumn("_compact", X.compact(F.col("text")))
    wanted = terms.withColumn("_needle", X.compact(F.col("term"))).filter(F.length("_needle") > 0)
    hits = contained_terms(squeezed, [*key, "ord"], "_compact", wanted, "_needle")
    pattern = X.loose_pattern(F.col("_needle"))
    return (
        hits.withColumn("count", X.count_literal(F.col("_compact"), F.col("_needle")))
        .withColumn("start", (F.regexp_instr(F.col("text"), pattern) - 1).cast("long"))
        .withColumn("span", F.length(F.regexp_extract_all(F.col("text"), pattern, F.lit(0))[0]).cast("long"))
        .drop("text", "_compact", "_needle")
    )


def occurrences(
    pages: DataFrame, terms: DataFrame, key: Sequence[str] = ("doc_id",), per_term: int | None = None
) -> DataFrame:
    """Every occurrence with its offset in the page, meant to be read in the order (page,
    offset); with ``per_term`` at most that many per document and term.

    Texts are split where they are read; lengths alone are shuffled, once, by document
    and term, and both windows use that layout.
    """
    hits = contained_terms(pages, [*key, "ord"], "text", terms)
    pieces = F.split(F.col("text"), X.quoted(F.col("term")), F.lit(-1))
    before = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p))
    cut = hits.select(
        *[c for c in hits.columns if c != "text"], F.posexplode(before).alias("_i", "_len")
    ).repartition(*key, "term")
    in_page = Window.partitionBy(*key, "term", "ord").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    offset = F.sum("_len").over(in_page) + F.col("_i") * F.length("term")
    placed = cut.withColumn("offset", offset.cast("long"))
    if per_term is not None:
        in_doc = Window.partitionBy(*key, "term").orderBy("ord", "_i")
        placed = placed.withColumn("_n", F.row_number().over(in_doc)).filter(F.col("_n") <= per_term).drop("_n")
    return placed.drop("_i", "_len")


def term_totals(terms: DataFrame, hits: DataFrame) -> DataFrame:
    """Occurrences per term, most frequent first; terms without any are kept and flagged."""
    n = hits.groupBy("term").agg(F.sum("count").alias("n"))
    return (
        terms.join(n, "term", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
        .withColumn("missed", F.col("n") == 0)
        .orderBy(F.desc("n"), "pos")
    )


def clean_terms(raw: DataFrame, key: Sequence[str] = ("query_id",)) -> DataFrame:
    """Trim, drop blanks, keep the first of equal terms, renumber."""
    t = raw.withColumn("term", X.strip(F.col("term"))).filter(F.length("term") > 0)
    t = first_wins(t, [*key, "term"], ["pos"])
    w = Window.partitionBy(*key).orderBy("pos")
    return t.withColumn("pos", F.row_number().over(w).cast("long"))


def or_expression(terms: DataFrame, key: Sequence[str] = ("query_id",)) -> DataFrame:
    """The cleaned terms of each query as one expression."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "term")))
    return clean_terms(terms, key).groupBy(*key).agg(
        F.array_join(F.transform(ordered, lambda s: s["term"]), " OR ").alias("expr"),
        F.count(F.lit(1)).alias("n_terms"),
    )


def query_groups(queries: DataFrame, key: str = "query_id", query: str = "query") -> DataFrame:
    """Terms of typed queries: ``key, group, pos, term``.  Blanks part groups that must all be
    met; a quoted run is one exact phrase.  Empty quotes and blank queries give no rows."""
    parts = F.regexp_extract_all(query, F.lit(r'(?U)"[^"]*"|[^\s"]+'), F.lit(0))
    found = queries.select(key, F.posexplode(parts).alias("_i", "_part"))
    term = X.strip(F.regexp_replace("_part", r'^"|"$', ""))
    pos = (F.col("_i") + 1).cast("long")
    return found.select(key, pos.alias("group"), pos.alias("pos"), term.alias("term")).filter("term <> ''")


def all_groups_match(hits: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents in which every group of a query is met by any of the group's terms."""
    wanted = terms.groupBy("query_id").agg(F.count_distinct("group").alias("n_groups"))
    met = (
        hits.select(key, "query_id", "group").distinct().groupBy(key, "query_id").agg(F.count(F.lit(1)).alias("n_met"))
    )
    return met.join(wanted, "query_id").filter("n_met = n_groups").select("query_id", key)


def merge_targets(hits: DataFrame, membership: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits of all terms in all targets as one row per file.

    ``membership(key, target, target_pos)`` says which targets hold a file.  Terms and
    targets are listed in task order (term first), the file's first hit is kept.
    """
    per_term = hits.groupBy(key, "term", "pos").agg(
        F.sum("count").alias("count"), F.min(F.struct("ord", "page")).alias("_first")
    )
    words = per_term.groupBy(key).agg(
        F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("_terms"),
        F.sum("count").alias("count"),
        F.min_by(F.col("_first.page"), F.col("pos")).alias("first_page"),
    )
    places = (
        membership.join(words.select(key), key, "left_semi")
        .groupBy(key)
        .agg(F.array_sort(F.collect_set(F.struct("target_pos", "target"))).alias("_targets"))
    )
    return words.join(places, key).select(
        key,
        F.transform("_terms", lambda s: s["term"]).alias("terms"),
        F.transform("_targets", lambda s: s["target"]).alias("targets"),
        "count",
        "first_page",
    )


def files_per_term(hits: DataFrame, key: str = "doc_id", approximate: bool = False) -> DataFrame:
    """Distinct files per term: a file counts once however often the term occurs."""
    if approximate:
        return hits.groupBy("term").agg(F.approx_count_distinct(key).alias("files"))
    return hits.select("term", key).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("files"))


def files_per_target(hits: DataFrame, membership: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct files per target, zero for a target that returned nothing."""
    found = hits.select(key).distinct().join(membership.select(key, "target").distinct(), key)
    n = found.groupBy("target").agg(F.count(F.lit(1)).alias("files"))
    return targets.join(n, "target", "left").withColumn("files", F.coalesce("files", F.lit(0)))


def silent_targets(per_target: DataFrame) -> DataFrame:
    return per_target.filter("files = 0")


def only_alias_hit(merged: DataFrame, main: str) -> DataFrame:
    """Flag files in which the main term itself does not occur."""
    return merged.withColumn("alias_only", ~F.array_contains("terms", main))


def hits_by_word(hits: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Pages (distinct, ascending) and total count per file and word, ranked per file by
    number of pages, then count, then word."""
    by = hits.filter("page >= 1 and term <> ''").groupBy(*key, F.col("term").alias("word")).agg(
        F.array_sort(F.collect_set("page")).alias("pages"), F.sum("count").alias("_sum")
    )
    by = by.withColumn("n_pages", F.size("pages").cast("long")).withColumn(
        "count", F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(F.col("n_pages"))
    )
    w = Window.partitionBy(*key).orderBy(F.desc("n_pages"), F.desc("count"), "word")
    return by.withColumn("rank", F.row_number().over(w).cast("long")).drop("_sum")


def page_steps(hits: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Next and previous page with a hit of the same word, around the end."""
    pages = hits.select(*key, "term", "page").distinct()
    w = Window.partitionBy(*key, "term").orderBy("page")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        pages.withColumn("next_page", F.coalesce(F.lead("page").over(w), F.first("page").over(whole)))
        .withColumn("prev_page", F.coalesce(F.lag("page").over(w), F.last("page").over(whole)))
        .withColumn("index", (F.row_number().over(w) - 1).cast("long"))
    )


def word_steps(by_word: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Next and previous word of a file, around the end, each with its first page."""
    w = Window.partitionBy(*key).orderBy("rank")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct("word", F.col("pages")[0].alias("page"))
    nxt = F.coalesce(F.lead(entry).over(w), F.first(entry).over(whole))
    prev = F.coalesce(F.lag(entry).over(w), F.last(entry).over(whole))
    return by_word.withColumn("_n", nxt).withColumn("_p", prev).select(
        *key,
        "word",
        "rank",
        F.col("_n.word").alias("next_word"),
        F.col("_n.page").alias("next_word_page"),
        F.col("_p.word").alias("prev_word"),
    )


def locate_page(by_word: DataFrame, asked: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Word and position of a page: the first word having a hit there, else (0, 0)."""
    at = by_word.select(*key, (F.col("rank") - 1).alias("word_no"), F.posexplode("pages").alias("page_no", "page"))
    best = at.groupBy(*key, "page").agg(F.min(F.struct("word_no", "page_no")).alias("b"))
    return asked.join(best, [*key, "page"], "left").select(
        *asked.columns,
        F.coalesce("b.word_no", F.lit(0)).cast("long").alias("word_no"),
        F.coalesce("b.page_no", F.lit(0)).cast("long").alias("page_no"),
    )


def recent_terms(history: DataFrame, user: str = "user_id", cap: int = 30) -> DataFrame:
    """Search history: newest first, each term once, at most ``cap`` per user."""
    latest = history.groupBy(user, "kw").agg(F.max("ts").alias("ts"))
    return top_per_key(latest, [user], [F.desc("ts"), F.asc("kw")], cap, "pos")
