"""File catalog: inventory rules, snapshot differences, name search, summaries, books."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.functions import text as X
from bibliomill.functions.dims import TERMS, broadcast_if_small
from bibliomill.functions.ranking import first_wins, numbered, top_per_key
from bibliomill.operators.search import contained_terms

# Directories never walked into, and extensions kept in a catalog.
SKIP_DIRS = (
    "$recycle.bin", "system volume information", "__pycache__", ".git",
    ".svn", "node_modules", ".idea", "$windows.~ws",
)
EXTS = (
    ".pdf", ".txt", ".md", ".epub", ".mobi", ".azw3", ".djvu", ".uvz", ".zip", ".rar",
    ".7z", ".pdg", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".json",
    ".html", ".htm", ".xml", ".rtf", ".wps", ".ofd", ".caj",
)
ROOT_TITLE = "(根目录)"


def kept_files(listing: DataFrame, root: str = "root", path: str = "path", exts: Sequence[str] = EXTS) -> DataFrame:
    """Listing rows a catalog keeps, with ``dir, name, stem, ext``.

    Directory names below the root decide what is skipped, whatever their case; names
    starting with a dot are skipped too.  A root may be written with or without scheme, host
    and final separators; where it does not begin the path, all of the path counts.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]+:(?://[^/]*)?(?=/)", ""), r"[\\/]+$", "")
    top, whole = plain(F.col(root)), plain(F.col(path))
    below = F.when(F.startswith(whole, top), F.substring(whole, F.length(top) + 1, F.length(whole))).otherwise(whole)
    folders = F.filter(F.split(X.dirname(below), r"[\\/]"), lambda d: d != "")
    skipped = F.exists(folders, lambda d: F.lower(d).isin(*SKIP_DIRS) | F.startswith(d, F.lit(".")))
    name = X.basename(F.col(path))
    return (
        listing.withColumn("ext", X.ext(name))
        .filter(F.col("ext").isin(*exts) & ~skipped)
        .withColumn("dir", X.dirname(F.col(path)))
        .withColumn("name", name)
        .withColumn("stem", X.stem(name))
    )


def _seconds(c: str) -> Column:
    return F.col(c).cast("double")


def snapshot_diff(old: DataFrame, new: DataFrame, scanned_roots: DataFrame | None = None) -> DataFrame:
    """Action per file of two snapshots keyed by (dir, name).

    ``same`` needs equal size and times less than a second apart, anything else is
    ``update``, also when the new time is older.  A file missing from the new snapshot is
    ``delete`` only when its root was scanned; the files of an absent root are ``held``.
    """
    roots = (scanned_roots if scanned_roots is not None else new.select("root")).select("root").distinct()
    o = old.select("dir", "name", *[F.col(c).alias(f"_o_{c}") for c in ("root", "size", "mtime")])
    n = new.select("dir", "name", *[F.col(c).alias(f"_n_{c}") for c in ("root", "size", "mtime")])
    seen = broadcast_if_small(roots.select(F.col("root").alias("_o_root"), F.lit(True).alias("_scanned")))
    both = o.join(n, ["dir", "name"], "full_outer").join(seen, "_o_root", "left")
    close = F.abs(_seconds("_o_mtime") - _seconds("_n_mtime")) < 1
    action = (
        F.when(F.col("_o_root").isNull(), "add")
        .when(F.col("_n_root").isNull(), F.when(F.col("_scanned"), "delete").otherwise("held"))
        .when((F.col("_o_size") == F.col("_n_size")) & close, "same")
        .otherwise("update")
    )
    taken = F.col("action").isin("add", "update")
    value = {c: F.when(taken, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in ("root", "size", "mtime")}
    return both.withColumn("action", action).select("dir", "name", "action", *value.values())


def apply_diff(diff: DataFrame) -> DataFrame:
    """The catalog after a difference."""
    return diff.filter("action <> 'delete'").drop("action")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("action").agg(F.count(F.lit(1)).alias("files"))


def name_search(files: DataFrame, keywords: DataFrame, limit: int | None = None, constant_limit: int = TERMS) -> DataFrame:
    """Files per keyword (``kw``): its characters in a row in the name, punctuation and
    case ignored; only a keyword without such a file falls back to plain containment in
    name or directory.  With ``limit`` at most that many files per keyword, by (dir, name),
    and their rank.
    """
    kws = keywords.select("kw").distinct()
    phrase = kws.withColumn("_k", X.letters_and_digits(F.col("kw"))).withColumn("_kind", F.lit(0))
    plain = kws.withColumn("_k", F.lower("kw")).withColumn("_kind", F.lit(1))
    key = ["dir", "name"]
    rows = files.select(*key, X.letters_and_digits(F.col("name")).alias("_text"))
    raw = files.select(*key, F.lower(F.concat_ws("\n", "name", "dir")).alias("_text"))
    hits = contained_terms(rows, key, "_text", phrase, "_k", constant_limit).unionByName(
        contained_terms(raw, key, "_text", plain, "_k", constant_limit)
    )
    best = top_per_key(
        hits.select("kw", "_kind", *key), ["kw"], [F.col("_kind"), F.col("dir"), F.col("name")], limit
    )
    first_kind = broadcast_if_small(hits.groupBy(F.col("kw").alias("_kw")).agg(F.min("_kind").alias("_first")))
    return best.join(first_kind, F.col("kw") == F.col("_kw")).filter("_kind = _first").select(
        "kw", *key, *(["rank"] if limit is not None else []), F.when(F.col("_kind") == 0, "phrase").otherwise("plain").alias("matched")
    )


def files_in_dirs(files: DataFrame, asked: DataFrame, exts: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Files of the asked directories (any case); with ``limit`` the first so many by name.
    Extensions are filtered before, so that a directory full of other files still shows these."""
    if exts is not None:
        files = files.filter(X.ext(F.col("name")).isin(*[e.lower() for e in exts]))
    want = broadcast_if_small(asked.select(F.lower("dir").alias("_d")).distinct())
    found = files.withColumn("_d", F.lower("dir")).join(want, "_d", "left_semi")
    return top_per_key(found, ["_d"], [F.col("name"), F.col("dir")], limit).drop("_d")


def dir_counts(files: DataFrame, exts: Sequence[str] = EXTS) -> DataFrame:
    kept = files.filter(X.ext(F.col("name")).isin(*[e.lower() for e in exts]))
    return kept.groupBy("dir").agg(F.count(F.lit(1)).alias("files"))


def stem_prefix(files: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Files whose stem begins with the prefix, any case; with ``limit`` the first by name."""
    hit = files.filter(F.startswith(F.lower(X.stem(F.col("name"))), F.lit(prefix.lower())))
    return hit if limit is None else hit.orderBy("name", "dir").limit(limit)


def catalog_stats(files: DataFrame, present: DataFrame) -> DataFrame:
    """Files, bytes, and how many files a fresh inventory no longer has (exact)."""
    gone = present.select("dir", "name").distinct().withColumn("_here", F.lit(True))
    return files.join(gone, ["dir", "name"], "left").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.count_if(F.col("_here").isNull()).alias("missing"),
    )


def filter_ext(files: DataFrame, exts: Sequence[str], exclude: bool = True) -> DataFrame:
    """Drop (or with ``exclude=False`` keep) extensions, given with or without dot."""
    if not exts:
        return files
    wanted = [e.lower() if e.startswith(".") else "." + e.lower() for e in exts]
    hit = X.ext(F.col("name")).isin(*wanted)
    return files.filter(~hit if exclude else hit)


def summarize(files: DataFrame) -> DataFrame:
    """Files and bytes per extension, with the total in the row whose ``ext`` is '*'."""
    by = files.withColumn("ext", X.ext(F.col("name"))).rollup("ext")
    return by.agg(
        F.grouping("ext").alias("_total"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    ).select(F.when(F.col("_total") == 1, "*").otherwise(F.col("ext")).alias("ext"), "files", "bytes")


def _title(directory: Column) -> Column:
    last = X.basename(F.regexp_replace(directory, r"[\\/]+$", ""))
    return F.coalesce(X.empty_to_null(last), F.lit(ROOT_TITLE))


def group_by_book(files: DataFrame, min_files: int = 1) -> DataFrame:
    """A directory is a book: title, number of files, bytes, first file; most files first."""
    by = files.groupBy("dir").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.min("name").alias("first_file")
    )
    return (
        by.filter(F.col("files") >= min_files)
        .withColumn("title", _title(F.col("dir")))
        .orderBy(F.desc("files"), "title", "dir")
    )


def book_files(files: DataFrame) -> DataFrame:
    """Files of each book numbered by name.  A directory may hold any share of the catalog."""
    return numbered(files, ["dir"], [F.col("name")], "file_no")


def top_books(files: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` first books, each with the file to open: its first PDF, else first file."""
    is_pdf = X.ext(F.col("name")) == ".pdf"
    by = files.groupBy("dir").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.min(F.struct(F.when(is_pdf, 0).otherwise(1), F.col("name").alias("name"))).alias("_open"),
    )
    return (
        by.withColumn("title", _title(F.col("dir")))
        .orderBy(F.desc("files"), "title", "dir")
        .limit(n)
        .select("dir", "title", "files", "bytes", F.col("_open.name").alias("open_file"))
    )


def ext_distribution(files: DataFrame, top: int = 6) -> DataFrame:
    by = files.groupBy(X.ext(F.col("name")).alias("ext")).agg(F.count(F.lit(1)).alias("files"))
    return by.orderBy(F.desc("files"), "ext").limit(top)


# ---- converted texts and their originals ------------------------------------------

# Endings that mark a text as converted between scripts.
CONVERTED_ENDINGS = ("_【繁转简】", "【繁转简】", "_【简转繁】", "【简转繁】")


def converted_ending(name: Column) -> Column:
    s = F.regexp_replace(name, r"(?i)\.txt$", "")
    hit = F.lit(None).cast("string")
    for e in reversed(CONVERTED_ENDINGS):
        hit = F.when(F.endswith(s, F.lit(e)), e).otherwise(hit)
    return F.coalesce(hit, F.lit(""))


def base_name(name: Column) -> Column:
    s = X.stem(name)
    e = converted_ending(F.concat(s, F.lit(".txt")))
    return F.substring(s, F.lit(1), F.length(s) - F.length(e))


def originals(files: DataFrame) -> DataFrame:
    """For every converted text the file to open instead: the PDF of the same base name, else
    the text itself; the unconverted text, if there is one; and how terms are to be converted."""
    f = files.select("dir", "name", X.ext(F.col("name")).alias("_ext"), base_name(F.col("name")).alias("base"))
    f = f.withColumn("ending", converted_ending(F.col("name")))
    plain = f.filter(F.col("ending") == "").groupBy("dir", "base").agg(
        F.min(F.when((F.col("_ext") == ".pdf"), F.col("name"))).alias("pdf"),
        F.min(F.when((F.col("_ext") == ".txt"), F.col("name"))).alias("txt"),
    )
    texts = f.filter((F.col("ending") != "") & (F.col("_ext") == ".txt"))
    to = F.when(F.col("ending") == "_【简转繁】", "t2s").otherwise("s2t")
    return texts.join(plain, ["dir", "base"], "left").select(
        "dir", "name", "base", "pdf", "txt",
        F.coalesce("pdf", "name").alias("open_file"), to.alias("terms_to"),
    )


# ---- targets: named corpora, their sources and groups -----------------------------


def target_sources(targets: DataFrame) -> DataFrame:
    """``target, pos, src`` from a location list separated by semicolons, first wins."""
    parts = F.transform(F.split("location", ";"), lambda p: F.regexp_replace(X.strip(p), r"[\\/]+$", ""))
    kept = F.array_distinct(F.filter(parts, lambda p: p != ""))
    return targets.select("target", F.posexplode(kept).alias("pos", "src"))


def match_watch(sources: DataFrame, watch: DataFrame) -> DataFrame:
    """Watch entry of a location: the equal path, else the first with the same last part."""
    w = watch.select(
        F.col("pos").alias("watch_pos"), "key", "expected", "main", "level",
        X.norm_path(F.col("expected")).alias("_wn"), X.basename(X.norm_path(F.col("expected"))).alias("_wb"),
    )
    w = broadcast_if_small(w)
    s = sources.withColumn("_n", X.norm_path(F.col("src"))).withColumn("_b", X.basename(F.col("_n")))
    exact = s.join(w, s["_n"] == w["_wn"]).withColumn("_prio", F.lit(0))
    named = s.join(w, s["_b"] == w["_wb"]).withColumn("_prio", F.lit(1))
    both = exact.unionByName(named).drop("_n", "_b", "_wn", "_wb")
    return first_wins(both, sources.columns, ["_prio", "watch_pos"]).drop("_prio")


def _known(present: DataFrame) -> DataFrame:
    return present.select(X.norm_path(F.col("dir")).alias("_n")).distinct().withColumn("_here", F.lit(True))


def dir_status(targets: DataFrame, watch: DataFrame, present: DataFrame) -> DataFrame:
    """State of every target from its source directories, and whether it may be updated."""
    src = target_sources(targets)
    matched = match_watch(src, watch).filter("main").select("target", "pos", "expected")
    here = _known(present)
    s = (
        src.withColumn("_n", X.norm_path(F.col("src")))
        .join(here, "_n", "left")
        .withColumn("_src_here", F.coalesce("_here", F.lit(False)))
        .drop("_n", "_here")
        .join(matched, ["target", "pos"], "left")
        .withColumn("_n", X.norm_path(F.col("expected")))
        .join(here, "_n", "left")
    )
    by = s.groupBy("target").agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(~F.col("_src_here")).alias("missing"),
        F.count("expected").alias("main"),
        F.count_if(F.col("expected").isNotNull() & F.col("_here").isNull()).alias("main_missing"),
    )
    state = (
        F.when(F.col("sources").isNull(), "unknown")
        .when(
            F.col("main") > 0,
            F.when(F.col("main_missing") == 0, "ok")
            .when(F.col("main_missing") < F.col("main"), "partial")
            .otherwise("missing"),
        )
        .otherwise(F.when(F.col("missing") < F.col("sources"), "ok").otherwise("missing"))
    )
    return (
        targets.select("target")
        .join(by, "target", "left")
        .withColumn("state", state)
        .withColumn("may_update", ~F.col("state").isin("unknown", "missing"))
        .withColumn("at_risk", F.col("may_update") & (F.col("missing") > 0))
        .na.fill(0, ["sources", "missing", "main", "main_missing"])
    )


def learned_watch(targets: DataFrame) -> DataFrame:
    """A watch list taken from the sources of the targets, one entry per location."""
    src = target_sources(targets).withColumn("_n", X.norm_path(F.col("src")))
    one = first_wins(src, ["_n"], ["target", "pos"])
    return one.select(
        X.basename(F.col("src")).alias("key"),
        F.col("src").alias("expected"),
        F.lit("optional").alias("level"),
        F.lit(True).alias("main"),
        F.struct("target", "pos").alias("pos"),
    )


def locate_dirs(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Where a directory is now: at its own place, else the first of the same name."""
    p = present.select("dir", X.norm_path(F.col("dir")).alias("_n")).distinct()
    own = p.groupBy("_n").agg(F.min("dir").alias("_own"))
    same = p.groupBy(X.basename(F.col("_n")).alias("_b")).agg(F.min("dir").alias("_same"))
    w = wanted.withColumn("_n", X.norm_path(F.col("expected"))).withColumn("_b", X.basename(F.col("_n")))
    got = w.join(own, "_n", "left").join(same, "_b", "left")
    return (
        got.withColumn("actual", F.coalesce(F.when(F.col("_own").isNotNull(), F.col("expected")), "_same"))
        .withColumn("translated", F.col("_own").isNull() & F.col("_same").isNotNull())
        .drop("_n", "_b", "_own", "_same")
    )


def check_watch(watch: DataFrame, targets: DataFrame, present: DataFrame) -> DataFrame:
    """Watch list with the present place of each entry.  A ``dual`` entry is shown only
    while its directory or a target holding it exists."""
    located = locate_dirs(watch, present)
    held = match_watch(target_sources(targets), watch).select("key", F.lit(True).alias("held")).distinct()
    shown = F.col("actual").isNotNull() | (F.col("level") != "dual") | F.coalesce("held", F.lit(False))
    return located.join(held, "key", "left").filter(shown).select(
        "key", "expected", "actual", F.col("actual").isNotNull().alias("found"), "translated", "level", "main"
    )


def hidden_targets(targets: DataFrame, watch: DataFrame, present: DataFrame) -> DataFrame:
    """Targets matched to a ``dual`` entry of which neither store nor any source exists."""
    src = target_sources(targets)
    level = first_wins(match_watch(src, watch).select("target", "pos", "level"), ["target"], ["pos"])
    here = _known(present)
    alive = (
        src.withColumn("_n", X.norm_path(F.col("src"))).join(here, "_n", "left_semi").select("target").distinct()
    )
    return targets.filter(~F.col("store_exists")).join(level.filter("level = 'dual'"), "target", "left_semi").join(
        alive, "target", "left_anti"
    )


def describe_targets(targets: DataFrame, watch: DataFrame, registered: DataFrame) -> DataFrame:
    """Watched collections each target contains, in source order, and whether it was known."""
    m = match_watch(target_sources(targets), watch).groupBy("target", "key").agg(F.min("pos").alias("pos"))
    books = m.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("_b"))
    known = registered.select("target").distinct().withColumn("registered", F.lit(True))
    return (
        targets.select("target")
        .join(books, "target", "left")
        .join(known, "target", "left")
        .select(
            "target",
            F.coalesce(F.transform("_b", lambda s: s["key"]), F.array().cast("array<string>")).alias("books"),
            F.coalesce("registered", F.lit(False)).alias("registered"),
        )
    )


def target_stats(files: DataFrame, target: str = "root") -> DataFrame:
    return files.groupBy(target).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("last_change")
    )


def resolve_targets(asked: DataFrame, groups: DataFrame) -> DataFrame:
    """Chosen names with own groups replaced by their members; the first mention counts."""
    g = groups.select(F.col("group").alias("name"), "member", "member_pos")
    # a name asked for again comes later with all its members
    first = asked.groupBy("name").agg(F.min(F.struct("pos")).alias("_first")).select("name", "_first.pos")
    flat = first.join(g, "name", "left").select(
        "pos", F.coalesce("member_pos", F.lit(0)).alias("member_pos"), F.coalesce("member", "name").alias("target")
    )
    return first_wins(flat.filter("target <> ''"), ["target"], ["pos", "member_pos"])


def unknown_members(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """Members a group may not have because no target carries their name."""
    names = targets.select(F.col("target").alias("member"))
    return groups.join(names, "member", "left_anti")


def path_group_targets(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """Groups whose members are stored as locations: each member becomes the name of the
    target kept there; one unknown member and the group stays as it is."""
    t = targets.select(X.norm_path(F.col("store")).alias("_n"), F.col("target")).groupBy("_n").agg(F.max("target").alias("target"))
    m = groups.withColumn("_n", X.norm_path(F.col("member"))).join(t, "_n", "left")
    whole = m.groupBy("group").agg(F.bool_and(F.col("target").isNotNull()).alias("_whole"))
    mapped = m.join(whole, "group").withColumn(
        "target", F.when(F.col("_whole"), F.col("target")).otherwise(F.col("group"))
    )
    return first_wins(mapped.select("group", "target", "member_pos"), ["group", "target"], ["member_pos"])
