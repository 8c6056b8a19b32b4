"""Text pages: marker detection, fixed-size fallback, and the page/offset mappings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.functions import text as X

# Page markers as converted texts write them, and the chunk length used
# where a text has fewer than three markers.  A third marker, ruled with hyphens, matches
# exactly as often as the one ruled with equals signs (the rules are optional), so ties
# always go to the latter and it needs no pattern of its own.
BRACKET_MARK = r"(?U)≦\s*(\d+)\s*≧"
RULED_MARK = r"(?U)(?:={6,}\s*\n\s*)?第\s*(\d+)\s*页(?:\s*\n\s*={6,})?"
MIN_MARKS = 3
CHUNK_CHARS = 500

_HEADER = (
    r"(?U)^(?:(?:[^\S\n]*\n)*+(?:[^\S\n]*\d{4}-\d{2}-\d{2}[^\S\n]+\d{2}:\d{2}:\d{2}[^\n]*"
    r"|[^\n]*?(?:http|\\\\)[^\n]*)(?:\n|\z))*+"
)


def header_end(content: Column) -> Column:
    """Length of the leading lines that are blank, a time stamp, or hold a link."""
    return F.length(F.regexp_extract(content, _HEADER, 0)).cast("long")


def _marks(content: Column, sign: str, pattern: str) -> Column:
    return F.when(F.contains(content, F.lit(sign)), F.regexp_count(content, F.lit(pattern))).otherwise(0)


def _with_segments(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_head`` (characters before the first segment) and ``_segments``."""
    d = docs.withColumn("_c", X.unix_lines(F.col(text)))
    c = F.col("_c")
    d = d.withColumn("_a", _marks(c, "≦", BRACKET_MARK)).withColumn("_b", _marks(c, "第", RULED_MARK))

    def between(pattern: str) -> Column:
        number = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        mark = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        body = F.slice(F.split(c, pattern, -1), 2, 1 << 30)
        return F.transform(
            F.arrays_zip(number.alias("number"), mark.alias("mark"), body.alias("body")),
            lambda s: F.struct(
                X.ascii_digits(s["number"]).try_cast("long").alias("page"),
                F.length(s["mark"]).cast("long").alias("lead"),
                s["body"].alias("text"),
                F.rlike(s["body"], F.lit(r"(?U)\S")).alias("keep"),
            ),
        )

    use_a = (F.col("_a") >= MIN_MARKS) & (F.col("_a") >= F.col("_b"))
    use_b = (F.col("_b") >= MIN_MARKS) & ~use_a
    d = d.withColumn("_m", F.when(use_a, between(BRACKET_MARK)).when(use_b, between(RULED_MARK)))
    marked = F.exists(F.col("_m"), lambda s: s["keep"])
    d = d.withColumn("_marked", F.coalesce(marked, F.lit(False)))
    d = d.withColumn(
        "_head",
        F.when(
            F.col("_marked"),
            F.length(F.when(use_a, F.split(c, BRACKET_MARK, 2)).otherwise(F.split(c, RULED_MARK, 2))[0]),
        )
        .otherwise(header_end(c))
        .cast("long"),
    )
    chunks = F.regexp_extract_all(
        F.substring(c, F.col("_head") + 1, F.length(c)), F.lit("(?s).{1,%d}" % CHUNK_CHARS), F.lit(0)
    )
    fallback = F.transform(
        chunks,
        lambda s, i: F.struct(
            (i + 1).cast("long").alias("page"),
            F.lit(0).cast("long").alias("lead"),
            s.alias("text"),
            F.lit(True).alias("keep"),
        ),
    )
    return d.withColumn("_segments", F.when(F.col("_marked"), F.col("_m")).otherwise(fallback))


def text_pages(docs: DataFrame, text: str = "text", with_total: bool = False) -> DataFrame:
    """One row per page: the other columns of ``docs`` plus ``ord``, ``page``, ``text``, and
    on request ``n_pages`` of the document.

    Row-local: a document is cut where it is read, nothing is shuffled.
    """
    keep = [c for c in docs.columns if c != text]
    kept = F.filter(F.col("_segments"), lambda s: s["keep"])
    cut = _with_segments(docs, text).withColumn("_kept", kept)
    total = [F.size("_kept").cast("long").alias("n_pages")] if with_total else []
    # The outer form keeps the optimizer from testing the pages for being there first,
    # which would cut every document twice.
    rows = cut.select(*keep, *total, F.posexplode_outer("_kept").alias("ord", "_s")).filter("_s is not null")
    return rows.select(
        *keep,
        *(["n_pages"] if with_total else []),
        F.col("ord").cast("long").alias("ord"),
        F.col("_s.page").alias("page"),
        F.col("_s.text").alias("text"),
    )


def chosen_pages(docs: DataFrame, choose: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Pages like those of :func:`text_pages`, but only those that ``choose`` keeps of a
    document's array of ``struct<ord, page, text>``; the others never become rows."""
    keep = [c for c in docs.columns if c != text]
    kept = F.filter(F.col("_segments"), lambda s: s["keep"])
    numbered = F.transform(kept, lambda s, i: F.struct(i.cast("long").alias("ord"), s["page"].alias("page"), s["text"].alias("text")))
    cut = _with_segments(docs, text).select(*keep, X.let(numbered, choose).alias("_chosen"))
    rows = cut.select(*keep, F.explode_outer("_chosen").alias("_s")).filter("_s is not null")
    return rows.select(*keep, "_s.ord", "_s.page", "_s.text")


def page_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ord, page, start, end``: character ranges, without the text itself.

    Only four numbers per page are shuffled; one document is at most one string long.
    """
    cut = _with_segments(docs.select(key, text), text).select(
        key,
        "_head",
        F.posexplode(
            F.transform(
                F.col("_segments"),
                lambda s: F.struct(
                    s["page"].alias("page"),
                    s["lead"].alias("lead"),
                    F.length(s["text"]).cast("long").alias("len"),
                    s["keep"].alias("keep"),
                ),
            )
        ).alias("ord", "s"),
    )
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_head") + F.sum(F.col("s.lead") + F.col("s.len")).over(w)
    return (
        cut.withColumn("end", end)
        .filter("s.keep")
        .select(
            key,
            F.col("ord").cast("long").alias("ord"),
            F.col("s.page").alias("page"),
            (F.col("end") - F.col("s.len")).alias("start"),
            "end",
        )
    )


def pages_at(positions: DataFrame, spans: DataFrame, key: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Page of a character offset: the first page that ends after it, else the last page.

    Offsets and page ends are merged per document and read in falling order, so that no
    offset is compared with every page.
    """
    ends = spans.select(key, F.col("end").alias("_at"), F.lit(0).alias("_kind"), "page", "ord")
    asked = positions.select(key, F.col(pos).cast("long").alias("_at"), F.lit(1).alias("_kind"))
    asked = asked.distinct()
    both = ends.unionByName(asked, allowMissingColumns=True)
    # An end equal to the offset does not lie after it: offsets are read first.
    back = Window.partitionBy(key).orderBy(F.desc("_at"), F.desc("_kind"), F.desc("ord"))
    run = back.rowsBetween(Window.unboundedPreceding, 0)
    found = (
        both.withColumn("_near", F.last("page", ignorenulls=True).over(run))
        .withColumn("_last", F.first("page", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .filter("_kind = 1")
        .select(key, F.col("_at").alias(pos), F.coalesce("_near", "_last").alias("page"))
    )
    return positions.join(found.withColumnRenamed("page", "page_at"), [key, pos], "left")


def offset_of_page(wanted: DataFrame, spans: DataFrame, key: str = "doc_id", number: str = "number") -> DataFrame:
    """Start offset of a printed page, or of the page with the nearest number.

    The first page wins among equal numbers and among equally near ones.
    """
    by_number = spans.groupBy(key, F.col("page").alias("_n")).agg(
        F.min(F.struct("ord", "start", F.col("page").alias("page"))).alias("_p")
    )
    asked = wanted.select(key, F.col(number).cast("long").alias("_n")).distinct()
    both = by_number.withColumn("_asked", F.lit(False)).unionByName(
        asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True
    )
    up = Window.partitionBy(key).orderBy(F.asc("_n"), F.asc("_asked")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc("_n"), F.asc("_asked")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_lo", F.last("_p", ignorenulls=True).over(up)).withColumn(
        "_hi", F.last("_p", ignorenulls=True).over(down)
    )

    def rank(p: str) -> Column:
        return F.when(
            F.col(p).isNotNull(),
            F.struct(F.abs(F.col(f"{p}.page") - F.col("_n")).alias("d"), F.col(f"{p}.ord").alias("o"), F.col(p).alias("p")),
        )

    best = F.least(rank("_lo"), rank("_hi"))
    return (
        near.filter("_asked")
        .withColumn("_best", best)
        .select(
            key,
            F.col("_n").alias(number),
            F.col("_best.p.start").alias("offset"),
            F.col("_best.p.page").alias("found"),
        )
    )


def image_only(pages: DataFrame, key: str = "doc_id", first: int = 24, docs: DataFrame | None = None) -> DataFrame:
    """Documents none of whose first pages carries any text.  ``docs`` adds the documents
    that have no page at all."""
    seen = F.max(F.when(F.rlike("text", F.lit(r"(?U)\S")), 1).otherwise(0))
    head = pages.filter(F.col("ord") < first)
    found = head.groupBy(key).agg((seen == 0).alias("image_only"))
    if docs is None:
        return found
    return docs.select(key).distinct().join(found, key, "left").select(key, F.coalesce("image_only", F.lit(True)).alias("image_only"))
