"""Old file locations mapped to new ones."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliomill.functions import text as X
from bibliomill.functions.dims import SMALL, broadcast_if_small, small_rows, struct_array
from bibliomill.session import cut_lineage

# Functions run by Python workers travel by value: no executor needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def active_rules(rules: DataFrame) -> DataFrame:
    """Rules that move something: marked as translated, and the two places differ."""
    return rules.filter(
        "translated and coalesce(expected, '') <> '' and coalesce(actual, '') <> ''"
    ).filter(X.norm_path(F.col("expected")) != X.norm_path(F.col("actual"))).select(
        "key", "expected", "actual", X.norm_path(F.col("expected")).alias("_n")
    )


def relocated(paths: DataFrame, rules: DataFrame, path: str = "path", limit: int = SMALL) -> DataFrame:
    """Add ``new_path`` and ``rule``: the longest rule whose place the path lies in.

    Paths and rules are compared without blanks around them, final separators and case; the
    longest rule in that form wins, then the smallest key.  A rule matches whole path parts
    only, and the rule for the root has the empty form.  Few rules travel with the scan; many
    are joined on the beginnings of each path, which grow with its depth and not with the
    number of rules.  Both ways give the same rows.
    """
    active = active_rules(rules)
    few = small_rows(active, limit)
    whole = X.strip(F.col(path))
    low = F.lower(whole)
    if few is not None:
        few.sort(key=lambda r: (-len(r["_n"]), r["key"], r["expected"], r["actual"]))
        table = struct_array(few, active.schema)
        hits = F.filter(
            table,
            lambda r: F.startswith(low, r["_n"])
            & (
                (F.length(low) == F.length(r["_n"]))
                | F.substring(low, F.length(r["_n"]) + 1, F.lit(1)).isin("/", "\\")
            ),
        )
        found = paths.withColumn("_r", F.get(hits, F.lit(0)))
    else:
        first = F.struct("key", "expected", "actual", "_n")
        one = broadcast_if_small(active.groupBy("_n").agg(F.min(first).alias("_r")))
        # Separators end the beginnings; the whole path is the last one, the root the first.
        pieces = F.split(low, r"(?=[\\/])")
        begin = F.transform(
            F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, 1, i), "")
        )
        root = F.when(F.substring(low, 1, 1).isin("/", "\\"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        spread = paths.select(path, low.alias("_low")).distinct().select(path, F.explode(F.array_distinct(F.concat(root, begin))).alias("_n"))
        best = (
            spread.join(one, "_n")
            .groupBy(path)
            .agg(F.max_by("_r", F.length("_n")).alias("_r"))
        )
        found = paths.join(best, path, "left")
    tail = F.substring(whole, F.length("_r._n") + 1, F.length(whole))
    # the tail brings its separator along, so the new place gives up its own
    place = F.when(tail == "", F.col("_r.actual")).otherwise(F.regexp_replace("_r.actual", r"[\\/]+$", ""))
    return (
        found.withColumn("new_path", F.coalesce(F.concat(place, tail), F.col(path)))
        .withColumn("rule", F.col("_r.key"))
        .withColumn("label", _label(F.col("_r.expected"), F.col("_r.actual")))
        .drop("_r")
    )


def _label(expected: Column, actual: Column) -> Column:
    a, b = F.substring(expected, 1, 2), F.substring(actual, 1, 2)
    return F.when(expected.isNull(), "").when(
        a != b, F.concat(F.lit("路径已转译："), a, F.lit(" → "), b)
    ).otherwise("路径已转译")


def path_map_entries(moves: DataFrame) -> DataFrame:
    """Lookup entries of remembered moves (``old_key, new_path, moved_at``).

    Each move is entered under its key and the key's normal form; under the bare file
    name as well, but only if the name did not change.  The latest move wins.
    """
    old, new = X.basename(F.col("old_key")), X.basename(F.col("new_path"))
    keys = F.array(
        X.strip(F.col("old_key")),
        X.norm_path(F.col("old_key")),
        F.when((old == new) & (old != ""), old),
    )
    rows = moves.select(F.explode(F.array_distinct(F.array_compact(keys))).alias("map_key"), "new_path", "moved_at")
    return rows.groupBy("map_key").agg(F.max_by("new_path", F.struct("moved_at", "new_path")).alias("new_path"))


def first_beginning_with(titles: DataFrame, names: DataFrame) -> DataFrame:
    """(title, found): the smallest ``found`` among the names (``name, found``) that begin with a
    title.

    Titles and names are laid in one order, dealt out by ranges.  The names that begin with a
    title follow it directly, so a task walks its range once and keeps the titles that are
    still open, each a beginning of the next.  A range starts with the titles open at its
    border, which are beginnings of its first entry.  What is shuffled are the titles and the
    names themselves and, per range, the beginnings of one entry.
    """
    width = max(1, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = titles.select(F.col("title").alias("entry"), F.lit(False).alias("named"), F.lit(None).cast("string").alias("found")).distinct()
    unique = names.groupBy(F.col("name").alias("entry")).agg(F.min("found").alias("found")).select("entry", F.lit(True).alias("named"), "found")
    laid = wanted.unionByName(unique).repartitionByRange(width, "entry", "named").withColumn("part", F.spark_partition_id())
    laid = cut_lineage(laid, "prefixes")
    border = laid.groupBy("part").agg(F.min("entry").alias("first"))
    beginnings = border.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda n: F.substring("first", F.lit(1), n))).alias("entry"))
    carried = laid.where("NOT named").select("entry", "named", "found").join(beginnings, "entry").select("entry", "named", "found", "part")
    order = ["part", "entry", "named"]
    dealt = laid.unionByName(carried).distinct().repartition(width, "part").sortWithinPartitions(*order)
    met = dealt.mapInPandas(_walk_beginnings, "title string, found string")
    return met.groupBy("title").agg(F.min("found").alias("found"))


def _walk_beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, open_titles = None, []  # [title, smallest found so far], each a beginning of the next

    def close(until: str | None) -> list[tuple[str, str]]:
        done = []
        while open_titles and (until is None or not until.startswith(open_titles[-1][0])):
            title, found = open_titles.pop()
            if found is not None:
                done.append((title, found))
                if open_titles and (open_titles[-1][1] is None or found < open_titles[-1][1]):
                    open_titles[-1][1] = found
        return done

    for batch in batches:
        out = []
        for of, entry, named, found in zip(batch["part"], batch["entry"], batch["named"], batch["found"]):
            if of != part:
                out += close(None)
                part = of
            out += close(entry)
            if not named:
                open_titles.append([entry, None])
            elif open_titles and (open_titles[-1][1] is None or found < open_titles[-1][1]):
                open_titles[-1][1] = found
        yield pd.DataFrame(out, columns=["title", "found"])
    yield pd.DataFrame(close(None), columns=["title", "found"])


def find_moved(wanted: DataFrame, moves: DataFrame, catalog: DataFrame) -> DataFrame:
    """Present path of recorded files, by falling certainty, tagged ``matched_by``.

    ``wanted(id, path, fn, size, npages)``; ``catalog(dir, name, size, npages)``.  The
    ways, by rank: remembered moves, equal fingerprint, equal last directories and name, a
    name that begins with the title.  The catalog is reduced to one file per key before
    it is joined, so a key shared by many files costs one row, and the best ranked way of
    a record is a minimum.
    """
    entries = path_map_entries(moves)
    cat = catalog.select("name", "size", "npages", X.join_path(F.col("dir"), F.col("name")).alias("_to"))
    name = F.coalesce("fn", X.basename(F.col("path")))

    probe = wanted.select(
        "id", F.posexplode(F.array(F.col("path"), X.norm_path(F.col("path")), name)).alias("_o", "map_key")
    )
    by_map = probe.join(entries, "map_key").select("id", "_o", F.col("new_path").alias("found"))

    prints = cat.groupBy(F.col("name").alias("fn"), "size", "npages").agg(F.min("_to").alias("found"))
    by_print = wanted.select("id", "fn", "size", "npages").join(prints, ["fn", "size", "npages"])

    def tail(p: Column) -> Column:
        return F.lower(F.regexp_extract(F.replace(p, F.lit("\\"), F.lit("/")), r"([^/]+/[^/]+)$", 1))

    tails = cat.groupBy(tail(F.col("_to")).alias("_tail")).agg(F.min("_to").alias("found")).filter("_tail <> ''")
    by_tail = wanted.select("id", tail(F.col("path")).alias("_tail")).join(tails, "_tail")

    titled = wanted.select("id", F.lower(X.stem(name)).alias("_title")).filter(F.length("_title") >= 2)
    names = cat.select(F.lower(X.stem(F.col("name"))).alias("name"), F.col("_to").alias("found")).filter(F.length("name") >= 2)
    begins = first_beginning_with(titled.select(F.col("_title").alias("title")), names)
    by_title = titled.join(begins, F.col("_title") == F.col("title")).select("id", "found")

    ways = by_map.select("id", F.struct("_o", "found").alias("b"))
    for rank, found in ((3, by_print), (4, by_tail), (5, by_title)):
        ways = ways.unionByName(found.select("id", F.struct(F.lit(rank).alias("_o"), "found").alias("b")))
    best = ways.groupBy("id").agg(F.min("b").alias("b"))
    tags = F.array(*[F.lit(t) for t in ("map", "map", "map", "fingerprint", "tail", "title")])
    return wanted.select("id").join(best, "id", "left").select(
        "id",
        F.col("b.found").alias("found"),
        F.coalesce(F.get(tags, F.col("b._o")), F.lit("none")).alias("matched_by"),
    )


def relocation_map(located: DataFrame) -> DataFrame:
    """Rows of a relocation dimension from a checked watch list."""
    return located.select(
        "key",
        "expected",
        F.coalesce("actual", F.lit("")).alias("actual"),
        F.coalesce("translated", F.lit(False)).alias("translated"),
    )
