"""The flagship: which documents mention an entity under any of its names, and through
which name each hit came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliomill.operators import aliases as A
from bibliomill.operators import paging as P
from bibliomill.operators import search as S
from bibliomill.plans.registry import Tables, query
from bibliomill.plans.search_queries import hits_oracle
from bibliomill.session import cut_lineage

NAMES = [("people", 0, 1, "the,and"), ("people", 0, 2, "der，que"), ("places", 1, 1, "que/zzqx-absent")]


def flagship(t: Tables, top: int = 20) -> DataFrame:
    """Expand the terms by the alias table, search all pages, merge per document."""
    lines = t.spark.createDataFrame(NAMES, "source string, source_rank int, line_no long, line string")
    asked = t.spark.createDataFrame([("the",), ("der",)], "term string")
    names = A.related(asked, A.parse_alias_lines(lines), None).select(F.col("value").alias("term"), F.hash("value").alias("pos"))
    names = cut_lineage(names, "names")
    docs = t.documents.select("doc_id", "source", "text")
    hits = S.page_hits(P.text_pages(S.documents_with_any(docs, names)), names)
    words = S.hits_by_word(hits).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list("word")), "、").alias("words"),
        F.max("n_pages").alias("most_pages"),
        F.sum("count").alias("count"),
    )
    return words.orderBy(F.desc("count"), "doc_id").limit(top)


@query(
    "flagship_top_documents",
    hits_oracle(
        """SELECT doc_id, string_agg(term, '、' ORDER BY term) AS words, CAST(max(n_pages) AS BIGINT) AS most_pages, CAST(sum(n) AS BIGINT) AS count
        FROM (SELECT doc_id, term, count(*) AS n_pages, sum(n) AS n FROM h1 GROUP BY 1, 2) GROUP BY doc_id ORDER BY count DESC, doc_id LIMIT 20"""
    ),
)
def _flagship(t: Tables) -> DataFrame:
    return flagship(t)
