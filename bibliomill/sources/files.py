"""File inventories, text decoding, dictionary files, hit lists and result lists."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliomill.functions import text as X
from bibliomill.functions.ranking import first_wins
from bibliomill.operators.catalog import EXTS, SKIP_DIRS, kept_files
from bibliomill.session import cut_lineage

# Encodings tried in order, and image formats of a snapshot folder.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "big5")
# Entries of a folder handed on at once.
LISTED_AT_ONCE = 10_000
# Characters of decoded texts a worker holds before it hands them on.
DECODED_BYTES = 4 << 20
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".webp")


LISTED = "root string, path string, folder boolean, size long, mtime timestamp"


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of folders, some at a time; a folder that cannot be read has none."""
    import os

    columns = ["root", "path", "folder", "size", "mtime"]
    for batch in batches:
        for root, path in zip(batch["root"], batch["path"]):
            out = []
            try:
                with os.scandir(path) as entries:
                    for e in entries:
                        try:
                            folder, stat = e.is_dir(follow_symlinks=False), e.stat()
                        except OSError:
                            continue
                        out.append((root, e.path, folder, stat.st_size, stat.st_mtime_ns // 1000))
                        if len(out) >= LISTED_AT_ONCE:
                            yield _stamped(pd.DataFrame(out, columns=columns))
                            out = []
            except OSError:
                pass
            yield _stamped(pd.DataFrame(out, columns=columns))


def _stamped(frame: pd.DataFrame) -> pd.DataFrame:
    frame["mtime"] = pd.to_datetime(frame["mtime"].astype("int64"), unit="us")
    return frame


def walked(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Files below mounted folders (``root, path, size, mtime``), listed by the executors.

    The folders of a level are dealt out to tasks; those to be skipped are dropped before
    anyone descends into them, and the next level starts from the rest.  Neither files nor
    folders pass the driver.  Links to folders are not followed.
    """
    level = spark.createDataFrame([(r, _mounted(r)) for r in roots], "root string, path string")
    found = None
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while True:
        listing = cut_lineage(level.repartition(width, "path").mapInPandas(_listed, LISTED), "listing")
        files = listing.where("NOT folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        name = F.lower(X.basename(F.col("path")))
        level = listing.where(F.col("folder") & ~name.isin(*SKIP_DIRS) & ~F.startswith(name, F.lit("."))).select("root", "path")
        if level.isEmpty():
            return found


def _mounted(root: str) -> str:
    return re.sub(r"^file:(?://[^/]*)?(?=/)", "", root)


def inventory(spark: SparkSession, roots: Sequence[str], exts: Sequence[str] = EXTS) -> DataFrame:
    """Files below the roots with ``root, dir, name, stem, ext, size, mtime``.

    Contents are never read, and a root that does not exist contributes nothing.  Folders that
    executors have mounted are walked by them; other stores are listed by Spark's reader.
    """
    mounted = [r for r in roots if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", _mounted(r))]
    listing = walked(spark, mounted) if mounted else None
    for root in [r for r in roots if r not in mounted]:
        try:
            one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        one = one.select(F.lit(root).alias("root"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        listing = one if listing is None else listing.unionByName(one)
    if listing is None:
        listing = spark.createDataFrame([], "root string, path string, size long, mtime timestamp")
    return kept_files(listing, exts=exts).drop("path")


def snapshots(files: DataFrame) -> DataFrame:
    """Images, newest first."""
    return files.filter(X.ext(F.col("name")).isin(*IMAGES)).orderBy(F.desc("mtime"), "dir", "name")


# Functions run by Python workers travel by value: no executor needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _decode(data: bytes | None, hint: str | None) -> str | None:
    if data is None:
        return None
    first = {"gb2312": "gb18030", "gbk": "gb18030"}.get((hint or "").lower(), hint)
    for encoding in dict.fromkeys([first, *ENCODINGS] if first else ENCODINGS):
        try:
            return data.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("utf-8", "replace")


@F.arrow_udf(T.StringType())
def _decode_batch(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The bytes of a batch stay where Arrow put them; one text at a time becomes an object, and
    texts are handed on before ``DECODED_BYTES`` of them gather."""
    for data, hint in batches:
        out, size = [], 0
        for d, h in zip(data, hint):
            out.append(_decode(d.as_py(), h.as_py()))
            size += len(out[-1] or "")
            if size >= DECODED_BYTES:
                yield pa.array(out, pa.string())
                out, size = [], 0
        yield pa.array(out, pa.string())


def decoded(content: Column, charset_hint: Column | None = None) -> Column:
    """Text of file bytes.  Valid UTF-8 without a contrary hint stays inside the engine;
    only other bytes travel to Python."""
    hint = F.lower(charset_hint) if charset_hint is not None else F.lit(None).cast("string")
    foreign = F.coalesce(~hint.isin("", "utf-8", "utf8", "utf-8-sig", "ascii"), F.lit(False))
    native = F.when(~foreign, F.regexp_replace(F.try_validate_utf8(content.cast("string")), r"\A\x{FEFF}", ""))
    return F.coalesce(native, _decode_batch(F.when(native.isNull(), content), hint))


def read_texts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, text`` of whole files in whatever encoding."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", decoded(F.col("content")).alias("text"))


def read_dictionary(spark: SparkSession, files: Sequence[tuple[str, str]]) -> DataFrame:
    """Numbered lines of dictionary files ``(source, path)``; their order is their rank.

    A file is numbered by splitting it as one value, as dictionaries are small and their
    line order decides between entries.
    """
    out = None
    for rank, (source, path) in enumerate(files):
        whole = spark.read.text(path, wholetext=True).select(
            F.lit(source).alias("source"),
            F.lit(rank).alias("source_rank"),
            F.posexplode(X.lines(F.regexp_replace("value", r"\A\x{FEFF}", ""))).alias("line_no", "line"),
        )
        out = whole if out is None else out.unionByName(whole)
    if out is None:
        raise ValueError("no dictionary files")
    return out


def publisher_dimension(rows: DataFrame) -> DataFrame:
    """``publisher, city, pos`` from ``(file_rank, line_no, name, city)``: first definition wins."""
    r = rows.withColumn("publisher", X.strip(F.col("name"))).withColumn("city", X.strip(F.col("city")))
    r = r.filter((F.col("publisher") != "") & ~F.startswith("name", F.lit("#")))
    one = first_wins(r.select("publisher", "file_rank", "line_no", "city"), ["publisher"], ["file_rank", "line_no"])
    return one.select("publisher", "city", F.struct("file_rank", "line_no").alias("pos"))


HIT_LIST = "file string, words array<struct<word: string, pages: array<bigint>, count: bigint>>"


def read_hit_lists(rows: DataFrame, json: str = "json") -> DataFrame:
    """Words of hit lists: ``file, word, pages, count``.  Damaged lists and items give no
    rows; pages are distinct and ascending, and a missing count is their number."""
    keep = [c for c in rows.columns if c != json]
    d = rows.withColumn("_h", F.from_json(json, HIT_LIST)).select(*keep, "_h.file", F.explode("_h.words").alias("w"))
    pages = F.array_sort(F.array_distinct(F.filter("w.pages", lambda p: p >= 1)))
    d = d.select(*keep, F.coalesce("file", F.lit("")).alias("file"), X.strip(F.col("w.word")).alias("word"), pages.alias("pages"), F.col("w.count").alias("_n"))
    d = d.filter((F.col("word") != "") & (F.size("pages") > 0))
    n = F.size("pages").cast("long")
    return d.withColumn("count", F.when(F.coalesce("_n", F.lit(0)) == 0, n).otherwise(F.col("_n"))).drop("_n")


def hit_lists(by_word: DataFrame, key: str = "doc_id", file: Column | None = None) -> DataFrame:
    """One JSON hit list per file from :func:`hits_by_word` rows, words in rank order."""
    item = F.struct("rank", F.struct("word", F.col("pages").cast("array<long>").alias("pages"), F.col("count").cast("long").alias("count")).alias("w"))
    words = F.transform(F.array_sort(F.collect_list(item)), lambda s: s["w"])
    name = file if file is not None else F.col(key).cast("string")
    by = by_word.groupBy(key).agg(words.alias("_w"))
    return by.select(key, F.to_json(F.struct(name.alias("file"), F.col("_w").alias("words"))).alias("json"))


RESULT_ITEM = "_isfolder string, name string, path string, type string, modified string, sizebytes string"


def _result_rows(d: DataFrame, include_folders: bool) -> DataFrame:
    folder = F.lower(F.coalesce(F.col("_isfolder"), F.lit(""))) == "true"
    name, path = X.strip(F.col("name")), F.coalesce(X.strip(F.col("path")), F.lit(""))
    glue = F.when((path == "") | F.rlike(path, F.lit(r"[\\/]$")), "").otherwise("\\")
    d = d.filter(F.coalesce(name, F.lit("")) != "")
    if not include_folders:
        d = d.filter(~folder)
    return d.select(
        F.concat(path, glue, name).alias("path"),
        name.alias("name"),
        F.coalesce(F.col("sizebytes").try_cast("long"), F.lit(0)).cast("long").alias("size"),
        F.when(folder, "文件夹").otherwise(F.coalesce(X.strip(F.col("type")), F.lit(""))).alias("type"),
        folder.alias("isfolder"),
        F.coalesce(X.strip(F.col("modified")), F.lit("")).alias("modified"),
    )


def read_results(spark: SparkSession, path: str, include_folders: bool = False) -> DataFrame:
    """Hits of result files written as XML; complete items of a truncated file are kept."""
    d = (
        spark.read.format("xml")
        .options(rowTag="file", mode="PERMISSIVE", ignoreNamespace="true")
        .schema(RESULT_ITEM)
        .load(path)
    )
    return _result_rows(d, include_folders)


def parse_results(rows: DataFrame, item: str = "item", include_folders: bool = False) -> DataFrame:
    """The same for items already cut into one string each."""
    d = rows.select(F.from_xml(item, RESULT_ITEM, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("_x"))
    return _result_rows(d.select("_x.*"), include_folders)
