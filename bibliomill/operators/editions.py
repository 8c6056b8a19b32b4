"""Versions of one work: clusters, redundant copies, siblings and related works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliomill.functions import names as N
from bibliomill.functions import text as X
from bibliomill.functions.ranking import numbered, top_per_key

# Companions accepted without their numbers, and related works per class.
LOOSE_LIMIT = 6
RELATED_PER_CLASS = 50
MIN_SERIES_CHARS = 3


def families(files: DataFrame) -> DataFrame:
    """Size of each family of one directory: files, formats, bytes and first name."""
    f = files.withColumn("family", N.family_key(F.col("name"))).withColumn("_ext", X.ext(F.col("name")))
    return f.groupBy("dir", "family").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("_ext") == ".pdf").alias("pdfs"),
        F.count_if(F.col("_ext") == ".txt").alias("texts"),
        F.sum("size").alias("bytes"),
        F.min("name").alias("first_name"),
    )


def redundant_texts(files: DataFrame) -> DataFrame:
    """``hidden`` and ``marked`` flags for texts beside a PDF of the same name.

    A text is hidden if such a PDF has the same number of hits, else kept and marked;
    texts converted between scripts are never hidden.  PDFs meet texts as distinct keys,
    never file by file.
    """
    f = files.withColumn("_d", F.lower("dir")).withColumn("_k", N.same_name_key(F.col("name"))).withColumn("_e", X.ext(F.col("name")))
    pdf = f.filter("_e = '.pdf'").select("_d", "_k", F.coalesce("count", F.lit(0)).alias("_c"))
    peer = pdf.select("_d", "_k").distinct().withColumn("_peer", F.lit(True))
    equal = pdf.distinct().withColumn("_equal", F.lit(True))
    is_text = F.col("_e").isin(".txt", ".text")
    d = f.withColumn("_c", F.coalesce("count", F.lit(0))).join(peer, ["_d", "_k"], "left").join(equal, ["_d", "_k", "_c"], "left")
    paired = is_text & F.coalesce("_peer", F.lit(False))
    hidden = paired & F.coalesce("_equal", F.lit(False)) & ~N.is_converted(F.col("name"))
    return d.select(*files.columns, hidden.alias("hidden"), (paired & ~hidden).alias("marked"))


def shown_files(files: DataFrame) -> DataFrame:
    return redundant_texts(files).filter("not hidden")


def hidden_files(files: DataFrame) -> DataFrame:
    return redundant_texts(files).filter("hidden").drop("hidden", "marked")


def sibling(files: DataFrame, candidates: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Best companion of each file among ``candidates(dir, name)`` as ``peer`` and ``how``.

    Same directory and family, unconverted texts first and the file itself before others;
    without one, a companion that differs by a library number only, unless more than six
    of the ``listed`` files would qualify.  Families are reduced to their best member
    before they are joined, so no pairs of members arise.
    """
    files = files if "fk" in files.columns else files.withColumn("fk", N.family_key(F.col("name")))
    conv = F.when(F.rlike("name", F.lit("[繁简]转[繁简]")), 1).otherwise(0)

    def keyed(df: DataFrame) -> DataFrame:
        k = df.select("dir", "name", conv.alias("conv"), N.family_key(F.col("name")).alias("fk"))
        return k.filter("fk <> ''").withColumn("lk", N.loose_key(F.col("fk")))

    cand = keyed(candidates)
    best = cand.groupBy("dir", "fk").agg(F.min(F.struct("conv", "name")).alias("_b"))
    own = cand.select("dir", "name", F.col("conv").alias("_own"))
    loose = cand.filter("lk <> ''").groupBy("dir", "lk").agg(F.min(F.struct("conv", "name")).alias("_l"))
    many = keyed(listed if listed is not None else candidates).groupBy("dir", "lk").agg(F.count(F.lit(1)).alias("_n"))
    loose = loose.join(many, ["dir", "lk"]).filter(F.col("_n") <= LOOSE_LIMIT).drop("_n")
    d = (
        files.withColumn("lk", N.loose_key(F.col("fk")))
        .join(best, ["dir", "fk"], "left")
        .join(own, ["dir", "name"], "left")
        .join(loose, ["dir", "lk"], "left")
    )
    family = F.when(F.col("_own") <= F.col("_b.conv"), F.col("name")).otherwise(F.col("_b.name"))
    return d.select(
        *files.columns,
        F.coalesce(family, F.col("_l.name")).alias("peer"),
        F.when(family.isNotNull(), "family").when(F.col("_l.name").isNotNull(), "loose").alias("how"),
    )


def _rank(tail: Column, e: Column) -> list[Column]:
    return [F.when(tail != "", 1).otherwise(0), F.when(e == ".pdf", 0).when(e == ".txt", 1).otherwise(2)]


def edition_groups(records: DataFrame) -> DataFrame:
    """One row per title (or raw name) and volume: versions, and the one to open first."""
    r = records.withColumn("work", F.coalesce(X.empty_to_null(F.col("title")), "name"))
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_rank(F.col("tail"), F.col("ext")))], F.col("path").alias("path")))
    return r.groupBy("work", "volume").agg(F.count(F.lit(1)).alias("versions"), first.alias("_f")).select(
        "work", "volume", "versions", F.col("_f.path").alias("first_path")
    )


def version_order(records: DataFrame) -> DataFrame:
    """Number the versions of each work: originals before converted ones, PDF, text, rest,
    then by path.  A work may have any number of versions."""
    r = records.withColumn("work", F.coalesce(X.empty_to_null(F.col("title")), "name"))
    o = _rank(F.col("tail"), F.col("ext"))
    return numbered(r, ["work", "volume"], [*o, F.col("path")], "version_no")


def work_keys(books: DataFrame) -> DataFrame:
    """``path, class, k``: the keys by which books ``(name, dir, path, author)`` are related.

    Classes are not exclusive: same series beginning (three characters or more), same
    folder name, same title, same author.  Books are related when they share a row's class
    and key; this is the whole relation, without a row for each pair.
    """
    folder = X.basename(F.regexp_replace("dir", r"[\\/]+$", ""))
    series = N.series_prefix(F.col("name"))
    keys = F.array(
        F.struct(F.lit("series").alias("class"), F.when(F.length(series) >= MIN_SERIES_CHARS, series).alias("k")),
        F.struct(F.lit("topic").alias("class"), X.empty_to_null(folder).alias("k")),
        F.struct(F.lit("same_book").alias("class"), X.empty_to_null(N.book_core(F.col("name"))).alias("k")),
        F.struct(F.lit("same_author").alias("class"), X.empty_to_null(F.col("author")).alias("k")),
    )
    rows = books.select("path", F.explode(keys).alias("_k")).select("path", F.col("_k.class").alias("class"), F.col("_k.k").alias("k"))
    return rows.filter("k is not null")


def related_works(books: DataFrame, per_class: int = RELATED_PER_CLASS) -> DataFrame:
    """``path, class, pos, related``: the first ``per_class`` related works of every book, as a
    reader is shown them.

    Each class keeps its first ``per_class + 1`` paths per key (:func:`work_keys`); every book
    then reads that bounded list without itself.
    """
    rows = work_keys(books)
    firsts = top_per_key(rows, ["class", "k"], [F.col("path")], per_class + 1)
    lists = firsts.groupBy("class", "k").agg(F.array_sort(F.collect_list("path")).alias("_list"))
    others = F.slice(F.filter("_list", lambda p: p != F.col("path")), 1, per_class)
    return rows.join(lists, ["class", "k"]).select("path", "class", F.posexplode(others).alias("pos", "related"))
