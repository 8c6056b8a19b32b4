"""Paging and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliomill.functions import text as X
from bibliomill.operators import paging as P
from bibliomill.operators import search as S
import bibliomill.plans.inputs  # noqa: F401  the derived inputs
from bibliomill.plans.registry import VIEWS, Tables, oracle, query
from bibliomill.session import cut_lineage

# The header rule and the 500-character pages in plain SQL.
HEADER = (
    "length(regexp_extract(text, '^(?:(?:[ \\t]*\\n)*(?:[ \\t]*\\d{4}-\\d{2}-\\d{2}[ \\t]+\\d{2}:\\d{2}:\\d{2}[^\\n]*"
    "|[^\\n]*?(?:http|\\\\\\\\)[^\\n]*)(?:\\n|$))*', 0))"
)
PAGES_SQL = f"""
SELECT doc_id, lang, source, i AS ord, i + 1 AS page, substr(text, h + i * 500 + 1, 500) AS t
FROM (SELECT doc_id, lang, source, text, h,
        unnest(range(0, CAST(ceil((length(text) - h) / 500.0) AS BIGINT))) AS i
      FROM (SELECT *, {HEADER} AS h FROM (SELECT * REPLACE (replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text) FROM documents)))"""
HITS_SQL = """
SELECT p.doc_id, p.source, p.ord, p.page, p.t, q.query_id, q.term, q.pos, q.grp,
  CAST((length(p.t) - length(replace(p.t, q.term, ''))) / length(q.term) AS BIGINT) AS n
FROM p JOIN v_terms q ON contains(p.t, q.term)"""
Q1 = """SELECT * FROM h WHERE query_id = 1"""


def hits_oracle(select: str, **more: str) -> str:
    return oracle(select, v_terms=VIEWS["v_terms"], p=PAGES_SQL, h=HITS_SQL, h1=Q1, **more)


def doc_pages(t: Tables) -> DataFrame:
    return P.text_pages(t.documents.select("doc_id", "lang", "source", "text"))


def terms1(t: Tables) -> DataFrame:
    return t.v_terms.filter("query_id = 1")


def hits1(t: Tables) -> DataFrame:
    docs = S.documents_with_any(t.documents.select("doc_id", "source", "text"), terms1(t))
    return S.page_hits(P.text_pages(docs), terms1(t))


@query(
    "txt_01_text_pages",
    oracle(
        "SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(page AS BIGINT) AS page, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM p",
        p=PAGES_SQL,
    ),
)
def _text_pages(t: Tables) -> DataFrame:
    return doc_pages(t).select(
        "doc_id", "ord", "page", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n")
    )


MARK_A = "≦[\\s\\p{Z}]*([0-9]+)[\\s\\p{Z}]*≧"
MARK_B = "(?:={6,}[\\s\\p{Z}]*\\n[\\s\\p{Z}]*)?第[\\s\\p{Z}]*([0-9]+)[\\s\\p{Z}]*页(?:[\\s\\p{Z}]*\\n[\\s\\p{Z}]*={6,})?"
MARKED_CTES = dict(
    c="SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM {v_marked}",
    n=f"""SELECT *, len(regexp_extract_all(text, '{MARK_A}')) AS a, len(regexp_extract_all(text, '{MARK_B}')) AS b FROM c""",
    k="SELECT *, CASE WHEN a >= 3 AND a >= b THEN 'a' WHEN b >= 3 THEN 'b' ELSE '-' END AS kind FROM n",
    m=f"""
SELECT doc_id, text, kind,
  CASE kind WHEN 'a' THEN string_split_regex(text, '{MARK_A}') WHEN 'b' THEN string_split_regex(text, '{MARK_B}') END AS pieces,
  CASE kind WHEN 'a' THEN regexp_extract_all(text, '{MARK_A}', 0) WHEN 'b' THEN regexp_extract_all(text, '{MARK_B}', 0) END AS marks,
  CASE kind WHEN 'a' THEN regexp_extract_all(text, '{MARK_A}', 1) WHEN 'b' THEN regexp_extract_all(text, '{MARK_B}', 1) END AS nums
FROM k""",
    s0="""
SELECT doc_id, pieces, marks, i - 1 AS ord, CAST(nums[i] AS BIGINT) AS page, pieces[i + 1] AS t,
  length(pieces[1]) + list_sum(list_transform(range(1, i + 1), lambda j: length(marks[j]))) + coalesce(list_sum(list_transform(range(2, i + 1), lambda j: length(pieces[j]))), 0) AS s
FROM (SELECT *, unnest(range(1, len(marks) + 1)) AS i FROM m WHERE kind <> '-')""",
    s1=f"""
SELECT doc_id, ord, page, t, CAST(s AS BIGINT) AS st, CAST(s + length(t) AS BIGINT) AS en FROM s0 WHERE regexp_matches(t, '[^\\s\\p{{Z}}]')""",
    f0=f"SELECT doc_id, text, {HEADER} AS h FROM m WHERE doc_id NOT IN (SELECT doc_id FROM s1)",
    f1="""
SELECT doc_id, i AS ord, i + 1 AS page, substr(text, h + i * 500 + 1, 500) AS t,
  h + i * 500 AS st, least(h + i * 500 + 500, length(text)) AS en
FROM (SELECT *, unnest(range(0, CAST(ceil((length(text) - h) / 500.0) AS BIGINT))) AS i FROM f0)""",
    spans="SELECT * FROM s1 UNION ALL SELECT * FROM f1",
)


@query(
    "txt_01_marked_pages",
    oracle("SELECT doc_id, CAST(page AS BIGINT) AS page, md5(t) AS digest FROM spans", **MARKED_CTES),
)
def _marked_pages(t: Tables) -> DataFrame:
    return P.text_pages(t.v_marked).select("doc_id", "page", F.md5("text").alias("digest"))


@query(
    "txt_02_header_end",
    oracle(f"SELECT doc_id, CAST({HEADER} AS BIGINT) AS header_end FROM c", c=MARKED_CTES["c"]),
)
def _header_end(t: Tables) -> DataFrame:
    return t.v_marked.select("doc_id", P.header_end(X.unix_lines(F.col("text"))).alias("header_end"))


@query(
    "txt_03_page_spans",
    oracle(
        "SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(st AS BIGINT) AS start_at, CAST(en AS BIGINT) AS end_at FROM spans",
        **MARKED_CTES,
    ),
)
def _page_spans(t: Tables) -> DataFrame:
    spans = P.page_spans(t.v_marked)
    return spans.select("doc_id", "page", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(
    "txt_03_page_at_offset",
    oracle(
        """
SELECT q.doc_id, q.pos, CAST(coalesce(min_by(s.page, s.en) FILTER (WHERE s.en > q.pos), max_by(s.page, s.en)) AS BIGINT) AS page
FROM q JOIN spans s USING (doc_id) GROUP BY q.doc_id, q.pos""",
        **MARKED_CTES,
        q="SELECT doc_id, unnest([0, 333, 700, 100000]) + doc_id % 50 AS pos FROM documents",
    ),
)
def _page_at(t: Tables) -> DataFrame:
    asked = t.documents.select(
        "doc_id",
        (F.explode(F.array(*[F.lit(v).cast("long") for v in (0, 333, 700, 100000)]))).alias("p0"),
    ).select("doc_id", (F.col("p0") + F.col("doc_id") % 50).alias("pos"))
    at = P.pages_at(asked, P.page_spans(t.v_marked))
    return at.filter("page_at is not null").select("doc_id", "pos", F.col("page_at").alias("page"))


@query(
    "txt_03_offset_of_page",
    oracle(
        """
SELECT q.doc_id, q.number, CAST(min_by(s.st, [CAST(abs(s.page - q.number) AS BIGINT), s.ord]) AS BIGINT) AS offset_at,
  CAST(min_by(s.page, [CAST(abs(s.page - q.number) AS BIGINT), s.ord]) AS BIGINT) AS found
FROM q JOIN spans s USING (doc_id) GROUP BY q.doc_id, q.number""",
        **MARKED_CTES,
        q="SELECT doc_id, doc_id % 12 AS number FROM documents",
    ),
)
def _offset_of_page(t: Tables) -> DataFrame:
    asked = t.documents.select("doc_id", (F.col("doc_id") % 12).alias("number"))
    got = P.offset_of_page(asked, P.page_spans(t.v_marked))
    return got.filter("found is not null").select("doc_id", "number", F.col("offset").alias("offset_at"), "found")


@query(
    "txt_04_page_hits",
    hits_oracle("SELECT doc_id, CAST(page AS BIGINT) AS page, term, n AS count FROM h1"),
)
def _page_hits(t: Tables) -> DataFrame:
    return hits1(t).select("doc_id", "page", "term", "count")


@query(
    "txt_04_page_hits_any_case",
    hits_oracle(
        "SELECT term, CAST(count(*) AS BIGINT) AS pages, CAST(sum((length(t) - length(replace(t, term, ''))) / length(term)) AS BIGINT) AS n "
        "FROM (SELECT lower(t) AS t, term FROM p JOIN (SELECT * FROM v_terms WHERE query_id = 1) q ON contains(lower(p.t), q.term)) GROUP BY term"
    ),
)
def _page_hits_ci(t: Tables) -> DataFrame:
    hits = S.page_hits(doc_pages(t), terms1(t), case_insensitive=True)
    return hits.groupBy("term").agg(F.count(F.lit(1)).alias("pages"), F.sum("count").alias("n"))


# A vocabulary taken from the documents themselves, far beyond the constant-table limit.
VOCABULARY = """
SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{5,9}')) AS w FROM documents)"""


VOCABULARY_SQL = oracle(
    "SELECT v.term, CAST(count(*) AS BIGINT) AS pages, CAST(count(DISTINCT p.doc_id) AS BIGINT) AS docs "
    "FROM s p JOIN v ON v.term = p.sub GROUP BY v.term",
    v=VOCABULARY,
    p=PAGES_SQL,
    s="SELECT DISTINCT doc_id, ord, substr(t, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS sub FROM (SELECT doc_id, ord, t, unnest(range(1, length(t) - 3)) AS i FROM p), (SELECT unnest(range(5, 10)) AS n)",
)


def vocabulary(t: Tables) -> DataFrame:
    found = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,9}"), F.lit(0)))
    return t.documents.select(found.alias("w")).select(F.lower("w").alias("term")).distinct().withColumn("pos", F.lit(0))


def vocabulary_counts(t: Tables, **options: int) -> DataFrame:
    hits = S.page_hits(doc_pages(t), vocabulary(t), **options)
    by_doc = hits.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("term").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("docs"))


@query("txt_04_large_vocabulary", VOCABULARY_SQL)
def _large_vocabulary(t: Tables) -> DataFrame:
    return vocabulary_counts(t)


@query("txt_04_large_vocabulary_joined", VOCABULARY_SQL)
def _large_vocabulary_joined(t: Tables) -> DataFrame:
    return vocabulary_counts(t, limit=64)


# Every word of every script and length; most of them occur inside others.
WORDS = "SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS term FROM documents"


@query(
    "txt_04_every_word",
    oracle(
        "SELECT term, CAST(count(*) AS BIGINT) AS pages, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs, "
        "CAST(sum((length(t) - length(replace(t, term, ''))) / length(term)) AS BIGINT) AS n FROM ("
        "SELECT s.doc_id, p.t, s.sub AS term FROM s JOIN p ON p.doc_id = s.doc_id AND p.ord = s.ord WHERE s.sub IN (SELECT term FROM v)) GROUP BY term",
        v="SELECT term FROM (" + WORDS + ") WHERE term <> ''",
        p=PAGES_SQL,
        s="SELECT DISTINCT doc_id, ord, substr(t, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS sub FROM (SELECT doc_id, ord, t, unnest(range(1, length(t) + 1)) AS i FROM p), (SELECT DISTINCT length(term) AS n FROM v) WHERE i + n <= length(t) + 1",
    ),
)
def _every_word(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(F.split("text", r"\s+")).alias("term")).where("term <> ''").distinct()
    words = cut_lineage(words, "words").withColumn("pos", F.lit(0))
    hits = S.page_hits(doc_pages(t), words)
    by_doc = hits.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("count").alias("n"))
    return by_doc.groupBy("term").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))


@query(
    "txt_05_snippets",
    hits_oracle(
        """
SELECT doc_id, CAST(page AS BIGINT) AS page, term,
  trim(regexp_replace(substr(t, greatest(i - 70, 0) + 1, i + 140 - greatest(i - 70, 0)), '[\\s\\p{Z}]+', ' ', 'g')) AS snippet
FROM (SELECT *, greatest(instr(t, term) - 1, 0) AS i FROM h1)"""
    ),
)
def _snippets(t: Tables) -> DataFrame:
    hits = S.page_hits(doc_pages(t), terms1(t), with_snippet=True)
    return hits.select("doc_id", "page", "term", "snippet")


@query(
    "txt_06_first_page",
    hits_oracle(
        "SELECT doc_id, CAST(min_by(page, ord * 1000 + pos) AS BIGINT) AS page, min_by(term, ord * 1000 + pos) AS term FROM h1 GROUP BY doc_id"
    ),
)
def _first_page(t: Tables) -> DataFrame:
    return S.first_page(hits1(t))


LOOSE = """
SELECT doc_id, page, pos, t, c, needle FROM (
  SELECT doc_id, ord, page, t, regexp_replace(t, '[\\s\\p{Z}\\x{FFFD}]+', '', 'g') AS c FROM p
) JOIN (SELECT 1 AS pos, 'delaré' AS needle UNION ALL SELECT 2, 'onthe' UNION ALL SELECT 3, 'derdie') ON contains(c, needle)"""


@query(
    "txt_07_blank_insensitive_hits",
    oracle(
        """
SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(pos AS BIGINT) AS pos,
  CAST((length(c) - length(replace(c, needle, ''))) / length(needle) AS BIGINT) AS count,
  CAST(instr(t, regexp_extract(t, pat)) - 1 AS BIGINT) AS start_at, CAST(length(regexp_extract(t, pat)) AS BIGINT) AS span
FROM (SELECT *, CASE pos WHEN 1 THEN 'd[\\s\\p{Z}\\x{FFFD}]*e[\\s\\p{Z}\\x{FFFD}]*l[\\s\\p{Z}\\x{FFFD}]*a[\\s\\p{Z}\\x{FFFD}]*r[\\s\\p{Z}\\x{FFFD}]*é'
   WHEN 2 THEN 'o[\\s\\p{Z}\\x{FFFD}]*n[\\s\\p{Z}\\x{FFFD}]*t[\\s\\p{Z}\\x{FFFD}]*h[\\s\\p{Z}\\x{FFFD}]*e'
   ELSE 'd[\\s\\p{Z}\\x{FFFD}]*e[\\s\\p{Z}\\x{FFFD}]*r[\\s\\p{Z}\\x{FFFD}]*d[\\s\\p{Z}\\x{FFFD}]*i[\\s\\p{Z}\\x{FFFD}]*e' END AS pat FROM z)""",
        p=PAGES_SQL,
        z=LOOSE,
    ),
)
def _loose(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([(1, "de la ré"), (2, "on\nthe"), (3, "der die")], "pos long, term string")
    hits = S.loose_hits(doc_pages(t), terms)
    return hits.select("doc_id", "page", "pos", "count", F.col("start").alias("start_at"), "span")


@query(
    "txt_08_occurrences_in_order",
    hits_oracle(
        """
SELECT doc_id, term, CAST(page AS BIGINT) AS page, CAST(off AS BIGINT) AS offset_at FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY ord, off) AS rn FROM (
    SELECT doc_id, term, page, ord, i,
      list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * length(term) AS off
    FROM (SELECT doc_id, term, page, ord, pieces, unnest(range(1, len(pieces))) AS i
          FROM (SELECT *, string_split(t, term) AS pieces FROM h1)))
)"""
    ),
)
def _occurrences(t: Tables) -> DataFrame:
    return S.occurrences(doc_pages(t), terms1(t)).select(
        "doc_id", "term", "page", F.col("offset").alias("offset_at")
    )


@query(
    "txt_09_term_totals",
    hits_oracle(
        "SELECT q.term, CAST(coalesce(sum(h1.n), 0) AS BIGINT) AS n, coalesce(sum(h1.n), 0) = 0 AS missed "
        "FROM (SELECT * FROM v_terms WHERE query_id = 1) q LEFT JOIN h1 USING (term) GROUP BY q.term"
    ),
)
def _term_totals(t: Tables) -> DataFrame:
    return S.term_totals(terms1(t), hits1(t)).select("term", "n", "missed")


@query(
    "txt_10_image_only",
    oracle(
        "SELECT doc_id, bool_and(NOT regexp_matches(CASE WHEN doc_id % 7 = 0 AND ord < 24 THEN ' ' ELSE t END, '[^\\s\\p{Z}]')) AS image_only "
        "FROM p WHERE ord < 24 AND doc_id % 11 <> 0 GROUP BY doc_id UNION ALL SELECT doc_id, true FROM documents WHERE doc_id % 11 = 0",
        p=PAGES_SQL,
    ),
)
def _image_only(t: Tables) -> DataFrame:
    # Scans are simulated by blanking the first pages of every seventh document.
    scanned = (F.col("doc_id") % 7 == 0) & (F.col("ord") < 24)
    pages = doc_pages(t).withColumn("text", F.when(scanned, " ").otherwise(F.col("text")))
    # Every eleventh document is a file without any page of text.
    return P.image_only(pages.filter("doc_id % 11 <> 0"), docs=t.documents)


RAW_TERMS = """
SELECT user_id AS query_id, event_id AS pos,
  CASE event_id % 5 WHEN 0 THEN ' ' || event_type WHEN 1 THEN event_type || ' ' WHEN 2 THEN ' ' ELSE event_type END AS term
FROM {events}"""


@query(
    "txt_11_or_expression",
    oracle(
        """
SELECT query_id, string_agg(term, ' OR ' ORDER BY pos) AS expr, CAST(count(*) AS BIGINT) AS n_terms
FROM (SELECT query_id, trim(term) AS term, min(pos) AS pos FROM r WHERE trim(term) <> '' GROUP BY 1, 2) GROUP BY query_id""",
        r=RAW_TERMS,
    ),
)
def _or_expression(t: Tables) -> DataFrame:
    return S.or_expression(t.sql(RAW_TERMS))


@query(
    "txt_12_all_groups",
    hits_oracle(
        """
SELECT query_id, doc_id FROM h JOIN (SELECT query_id, count(DISTINCT grp) AS g FROM v_terms GROUP BY 1) USING (query_id)
GROUP BY query_id, doc_id, g HAVING count(DISTINCT grp) = g"""
    ),
)
def _all_groups(t: Tables) -> DataFrame:
    terms = t.v_terms.withColumnRenamed("grp", "group")
    hits = S.page_hits(doc_pages(t), terms)
    return S.all_groups_match(hits, terms).select("query_id", "doc_id")


# Typed queries of every customer; the groups are known from the way they are written.
TYPED = """
SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN ' the  "of the" ' WHEN 1 THEN 'name' || CAST(c_custkey AS STRING) || ' ""tion' WHEN 2 THEN '   '
  ELSE '"k ' || CAST(c_custkey AS STRING) || '" x' END AS query FROM {customer}"""


@query(
    "txt_12_query_groups",
    """
SELECT c_custkey AS query_id, g AS grp, CASE WHEN c_custkey % 4 = 0 THEN CASE g WHEN 1 THEN 'the' ELSE 'of the' END
  WHEN c_custkey % 4 = 1 THEN CASE g WHEN 1 THEN 'name' || c_custkey ELSE 'tion' END ELSE CASE g WHEN 1 THEN 'k ' || c_custkey ELSE 'x' END END AS term
FROM customer, (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT)), (CAST(3 AS BIGINT))) AS n(g)
WHERE c_custkey % 4 <> 2 AND CASE WHEN c_custkey % 4 = 1 THEN g <> 2 ELSE g <> 3 END""",
)
def _query_groups(t: Tables) -> DataFrame:
    return S.query_groups(t.sql(TYPED)).select("query_id", F.col("group").alias("grp"), "term")


MERGED = """
SELECT doc_id, string_agg(term, '、' ORDER BY pos) AS terms, CAST(sum(n) AS BIGINT) AS count
FROM (SELECT doc_id, term, pos, sum(n) AS n FROM h1 GROUP BY ALL) GROUP BY doc_id"""
PLACES = "SELECT doc_id, string_agg(target, '、' ORDER BY target_pos) AS targets FROM {v_membership} GROUP BY doc_id"
FIRST = "SELECT doc_id, min_by(page, pos * 1000000 + ord) AS first_page FROM h1 GROUP BY doc_id"


@query(
    "txt_13_terms_by_targets",
    hits_oracle(
        "SELECT doc_id, terms, targets, count, CAST(first_page AS BIGINT) AS first_page FROM g JOIN pl USING (doc_id) JOIN f USING (doc_id)",
        g=MERGED,
        pl=PLACES,
        f=FIRST,
    ),
)
def _terms_by_targets(t: Tables) -> DataFrame:
    merged = S.merge_targets(hits1(t), t.v_membership)
    return merged.select(
        "doc_id",
        F.array_join("terms", "、").alias("terms"),
        F.array_join("targets", "、").alias("targets"),
        "count",
        "first_page",
    )


@query(
    "txt_14_files_per_term",
    hits_oracle("SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS files FROM h1 GROUP BY term"),
)
def _files_per_term(t: Tables) -> DataFrame:
    return S.files_per_term(hits1(t))


TARGETS = "SELECT DISTINCT target FROM (SELECT target FROM {v_membership} UNION ALL SELECT 'closed-' || lang AS target FROM {documents})"


@query(
    "txt_14_files_per_target",
    hits_oracle(
        "SELECT tg.target, CAST(count(DISTINCT h1.doc_id) AS BIGINT) AS files FROM tg LEFT JOIN {v_membership} m ON m.target = tg.target LEFT JOIN h1 ON h1.doc_id = m.doc_id GROUP BY tg.target",
        tg=TARGETS,
    ),
)
def _files_per_target(t: Tables) -> DataFrame:
    return S.files_per_target(hits1(t), t.v_membership, t.sql(TARGETS)).select(
        "target", F.col("files").cast("long").alias("files")
    )


@query(
    "txt_15_silent_targets",
    hits_oracle(
        "SELECT target FROM tg WHERE target NOT IN (SELECT target FROM {v_membership} m WHERE m.doc_id IN (SELECT doc_id FROM h1))",
        tg=TARGETS,
    ),
)
def _silent_targets(t: Tables) -> DataFrame:
    return S.silent_targets(S.files_per_target(hits1(t), t.v_membership, t.sql(TARGETS))).select("target")


@query(
    "txt_16_only_alias_hit",
    hits_oracle("SELECT doc_id, bool_and(term <> 'the') AS alias_only FROM h1 GROUP BY doc_id"),
)
def _only_alias(t: Tables) -> DataFrame:
    merged = S.merge_targets(hits1(t), t.v_membership)
    return S.only_alias_hit(merged, "the").select("doc_id", "alias_only")


BYWORD = """
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_pages DESC, count DESC, word) AS rank FROM (
  SELECT doc_id, term AS word, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, min(page) AS p0,
    count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS count FROM h1 GROUP BY doc_id, term)"""


@query(
    "txt_19_hits_by_word",
    hits_oracle(
        "SELECT doc_id, word, pages, CAST(n_pages AS BIGINT) AS n_pages, count, CAST(rank AS BIGINT) AS rank FROM w", w=BYWORD
    ),
)
def _hits_by_word(t: Tables) -> DataFrame:
    by = S.hits_by_word(hits1(t))
    return by.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(
    "txt_20_page_steps",
    hits_oracle(
        """
SELECT doc_id, term, CAST(page AS BIGINT) AS page,
  CAST(coalesce(lead(page) OVER w, min(page) OVER (PARTITION BY doc_id, term)) AS BIGINT) AS next_page,
  CAST(coalesce(lag(page) OVER w, max(page) OVER (PARTITION BY doc_id, term)) AS BIGINT) AS prev_page,
  CAST(row_number() OVER w - 1 AS BIGINT) AS index
FROM h1 WINDOW w AS (PARTITION BY doc_id, term ORDER BY page)"""
    ),
)
def _page_steps(t: Tables) -> DataFrame:
    return S.page_steps(hits1(t))


@query(
    "txt_20_word_steps",
    hits_oracle(
        """
SELECT doc_id, word, coalesce(lead(word) OVER w, first_value(word) OVER w) AS next_word,
  CAST(coalesce(lead(p0) OVER w, first_value(p0) OVER w) AS BIGINT) AS next_word_page,
  coalesce(lag(word) OVER w, last_value(word) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_word
FROM w WINDOW w AS (PARTITION BY doc_id ORDER BY rank)""",
        w=BYWORD,
    ),
)
def _word_steps(t: Tables) -> DataFrame:
    return S.word_steps(S.hits_by_word(hits1(t))).drop("rank")


@query(
    "txt_20_locate_page",
    hits_oracle(
        """
SELECT a.doc_id, CAST(a.page AS BIGINT) AS page, CAST(coalesce(min(e.rank - 1), 0) AS BIGINT) AS word_no,
  CAST(coalesce(min_by(e.k, e.rank), 0) AS BIGINT) AS page_no
FROM (SELECT doc_id, doc_id % 9 + 1 AS page FROM documents) a
LEFT JOIN (SELECT h1.doc_id, h1.page, w.rank, row_number() OVER (PARTITION BY h1.doc_id, h1.term ORDER BY h1.page) - 1 AS k
           FROM h1 JOIN w ON w.doc_id = h1.doc_id AND w.word = h1.term) e
ON e.doc_id = a.doc_id AND e.page = a.page GROUP BY a.doc_id, a.page""",
        w=BYWORD,
    ),
)
def _locate_page(t: Tables) -> DataFrame:
    asked = t.documents.select("doc_id", (F.col("doc_id") % 9 + 1).alias("page"))
    return S.locate_page(S.hits_by_word(hits1(t)), asked)


@query(
    "txt_24_recent_terms",
    """
SELECT user_id, kw, CAST(epoch_us(ts) AS BIGINT) AS at_us, CAST(pos AS BIGINT) AS pos FROM (
  SELECT user_id, kw, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, kw) AS pos FROM (
    SELECT user_id, event_type || '-' || CAST(event_id % 50 AS VARCHAR) AS kw, max(ts) AS ts FROM events GROUP BY 1, 2)) WHERE pos <= 30""",
)
def _recent_terms(t: Tables) -> DataFrame:
    history = t.events.select(
        "user_id", F.concat_ws("-", "event_type", (F.col("event_id") % 50).cast("string")).alias("kw"), "ts"
    )
    return S.recent_terms(history).select(
        "user_id", "kw", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("pos").cast("long").alias("pos")
    )
