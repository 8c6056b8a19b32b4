"""Excerpt and snapshot notebooks: Markdown to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliomill.functions import text as X

# Headings, quote marks and the machine-readable note of the format.
EXCERPT_HEAD = r"(?Umd)^###\s*摘录\s*·\s*"
SNAPSHOT_HEAD = r"(?Umd)^###\s+"
TITLE = "# 摘录本\n\n> 每条摘录附带出处。\n"
NOTE_OPEN, NOTE_CLOSE = "<!-- cv:", "-->"
CITE_STARTS = ("> ——", ">——", "> 《")
CITED_FILE = r"(?iuU)文件[:：]\s*([^｜|\n]+?\.(?:pdf|epub|txt|md|xps|cbz|mobi|fb2|svg))"
CITED_PAGE = r"(?U)第\s*(\d+)\s*[页頁]"
SHOT_TIME, SHOT_NOTE, SHOT_TEXT = "截图时间：", "备注：", "【下面这段"
SHOT_PAGES = ("跨页：", "页码：", "参考页码：")
META_KEYS = (("src", "src"), ("page", "page"), ("fn", "fn"), ("size", "sz"), ("npages", "np"))


def is_note(line: Column) -> Column:
    s = X.strip(line)
    return F.startswith(s, F.lit(NOTE_OPEN)) & F.endswith(s, F.lit(NOTE_CLOSE))


def note_fields(line: Column) -> Column:
    """``struct<src, page, fn, size, npages, cite>`` of a note line; the citation comes last
    and may contain anything."""
    inner = X.strip(F.regexp_extract(line, r"(?s)<!--\s*cv:(.*?)-->", 1))
    cite = X.strip(F.regexp_extract(inner, r"(?s)cite=(.*)$", 1))
    pairs = F.str_to_map(F.regexp_replace(inner, r"(?s)cite=.*$", ""), F.lit(r"\s*\|\s*"), F.lit("="))
    value = lambda k: F.coalesce(X.strip(F.try_element_at(pairs, F.lit(k))), F.lit(""))
    return F.struct(*[value(k).alias(name) for name, k in META_KEYS], cite.alias("cite"))


def note_line(src: Column, page: Column, cite: Column, fn: Column, size: Column, npages: Column) -> Column:
    """The note of a record; empty where nothing is known."""
    plain = lambda c, by: F.replace(F.replace(c, F.lit("|"), F.lit(by)), F.lit("\n"), F.lit(" "))
    told = lambda k, c: F.when((F.coalesce(c, F.lit("")) != "") & (c != "0"), F.concat(F.lit(f"{k}="), plain(c, "｜")))
    no = page.try_cast("long")
    parts = F.array_compact(
        F.array(
            F.when(F.coalesce(src, F.lit("")) != "", F.concat(F.lit("src="), F.replace(src, F.lit("|"), F.lit(" ")))),
            F.when(no > 0, F.concat(F.lit("page="), no.cast("string"))),
            told("fn", fn), told("sz", size), told("np", npages), told("cite", cite),
        )
    )
    return F.when(F.size(parts) > 0, F.concat(F.lit(NOTE_OPEN), F.array_join(parts, "|"), F.lit(" "), F.lit(NOTE_CLOSE + "\n"))).otherwise("")


def cited_hints(cite: Column) -> Column:
    """``struct<file, page>`` read from the words of a citation of an old record."""
    named = X.basename(X.strip(F.regexp_extract(cite, CITED_FILE, 1)))
    title = X.strip(F.regexp_extract(cite, "《([^》]+)》", 1))
    return F.struct(
        F.coalesce(X.empty_to_null(named), title).alias("file"), F.regexp_extract(cite, CITED_PAGE, 1).alias("page")
    )


def _unquoted(line: Column) -> Column:
    return F.when(F.startswith(line, F.lit("> ")), F.substring(line, F.lit(3), F.length(line))).when(
        F.startswith(line, F.lit(">")), F.substring(line, F.lit(2), F.length(line))
    ).otherwise(line)


def _joined(lines: Column) -> Column:
    """Lines as text without empty lines at either end."""
    s = F.regexp_replace(F.array_join(lines, "\n"), r"(?U)(?:\n\s*)+\z", "")
    return F.when(F.rlike(s, F.lit(r"(?U)\S")), F.regexp_replace(s, r"^\n+", "")).otherwise("")


def _excerpt(block: Column) -> Column:
    lines = F.split(block, "\n", -1)
    rows = F.transform(lines, lambda l, i: F.struct(l.alias("l"), X.strip(l).alias("s"), i.alias("i"), is_note(l).alias("note")))

    def read(rs: Column) -> Column:
        def opens_cite(r: Column) -> Column:
            ahead = F.filter(F.slice(rs, r["i"] + 2, 3), lambda n: n["s"] != "")
            s = F.coalesce(F.get(ahead, F.lit(0))["s"], F.lit(""))
            return F.exists(F.array(*[F.lit(p) for p in CITE_STARTS]), lambda p: F.startswith(s, p))

        def split_at(sep: Column) -> Column:
            body = F.filter(rs, lambda r: (r["i"] > 0) & ~r["note"] & (r["i"] < sep) & (r["s"] != ""))
            cite = F.filter(rs, lambda r: (r["i"] > sep) & ~r["note"] & (r["s"] != ""))
            text = lambda part: _joined(F.transform(part, lambda r: F.when(r["s"] == ">", "").otherwise(_unquoted(r["l"]))))
            return F.struct(
                rs[0]["s"].alias("ts"), text(body).alias("body"), text(cite).alias("citation"),
                note_fields(F.coalesce(F.try_element_at(F.filter(rs, lambda r: r["note"]), F.lit(-1))["s"], F.lit(""))).alias("m"),
            )

        seps = F.filter(rs, lambda r: (r["i"] > 0) & ~r["note"] & (r["s"] == ">") & opens_cite(r))
        return X.let(F.coalesce(F.get(seps, F.lit(0))["i"], F.lit(1 << 30)), split_at)

    return X.let(rows, read)


def _blocks(notebooks: DataFrame, key: str, md: str, head: str) -> DataFrame:
    blocks = F.split(X.unix_lines(F.col(md)), head, -1)
    return notebooks.select(key, F.posexplode(F.slice(blocks, 2, 1 << 30)).alias("block_no", "_block"))


def parse_excerpts(notebooks: DataFrame, key: str = "notebook", md: str = "md") -> DataFrame:
    """Records of excerpt notebooks: ``ts, body, cite, src, page, cite_std, file_hint, fn,
    size, npages``.

    A bare ``>`` parts body and citation only if the next of up to three lines that is not
    blank starts a citation; otherwise it is an empty line of the body.  A record that
    notes no file is searched for hints in the words of its citation.
    """
    r = _blocks(notebooks, key, md, EXCERPT_HEAD).withColumn("_r", _excerpt(F.col("_block")))
    c = F.col
    hints = cited_hints(c("_r.citation"))
    unknown = c("_r.m.src") == ""
    return r.select(
        key, "block_no",
        c("_r.ts").alias("ts"), c("_r.body").alias("body"), c("_r.citation").alias("cite"), c("_r.m.src").alias("src"),
        F.when(unknown & (c("_r.m.page") == ""), hints["page"]).otherwise(c("_r.m.page")).alias("page"),
        c("_r.m.cite").alias("cite_std"),
        F.when(unknown, hints["file"]).otherwise("").alias("file_hint"),
        c("_r.m.fn").alias("fn"), c("_r.m.size").alias("size"), c("_r.m.npages").alias("npages"),
    ).filter("body <> '' or cite <> ''")


def _quote(text: Column) -> Column:
    return F.array_join(
        F.transform(X.lines(F.rtrim(text, F.lit("\n"))), lambda l: F.when(X.strip(l) == "", ">").otherwise(F.concat(F.lit("> "), l))), "\n"
    )


def excerpt_markdown(records: DataFrame) -> DataFrame:
    """Add ``markdown``: the block of each record; fingerprints are kept."""
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    note = note_line(c("src"), c("page"), c("cite_std"), c("fn"), c("size"), c("npages"))
    block = F.concat(F.lit("\n### 摘录 · "), c("ts"), F.lit("\n"), _quote(c("body")), F.lit("\n>\n"), _quote(c("cite")), F.lit("\n"), note)
    return records.filter("coalesce(body, '') <> '' or coalesce(cite, '') <> ''").withColumn("markdown", block)


def notebook_markdown(records: DataFrame, key: str = "notebook", order: str = "block_no") -> DataFrame:
    """Whole notebooks from their records."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("markdown").alias("m"))))
    joined = F.array_join(F.transform(blocks, lambda b: b["m"]), "")
    return excerpt_markdown(records).groupBy(key).agg(F.concat(F.lit(TITLE), joined).alias("md"))


def _snapshot(block: Column) -> Column:
    rows = F.transform(
        F.split(block, "\n", -1),
        lambda l, i: F.struct(X.strip(l).alias("s"), i.alias("i"), is_note(l).alias("note")),
    )

    def read(rs: Column) -> Column:
        head = rs[0]["s"]
        quoted = F.filter(
            F.transform(
                F.filter(rs, lambda r: (r["i"] > 0) & ~r["note"] & F.startswith(r["s"], F.lit(">"))),
                lambda r: F.struct(X.strip(F.substring(r["s"], F.lit(2), F.length(r["s"]))).alias("c"), r["i"].alias("i")),
            ),
            lambda q: q["c"] != "",
        )
        images = F.filter(rs, lambda r: (r["i"] > 0) & ~r["note"] & F.startswith(r["s"], F.lit("![")) & F.contains(r["s"], F.lit("](")))

        def fields(qs: Column) -> Column:
            starts = lambda q, p: F.startswith(q["c"], F.lit(p))
            last = lambda p, n: F.coalesce(
                F.try_element_at(F.transform(F.filter(qs, lambda q: starts(q, p)), lambda q: X.strip(F.substring(q["c"], F.lit(n), F.length(q["c"])))), F.lit(-1)),
                F.lit(""),
            )
            text_at = F.coalesce(F.get(F.filter(qs, lambda q: starts(q, SHOT_TEXT)), F.lit(0))["i"], F.lit(1 << 30))

            def rest(at: Column) -> Column:
                free = lambda q: ~F.rlike(q["c"], F.lit("^(?:" + "|".join((SHOT_TIME, SHOT_NOTE, SHOT_TEXT, *SHOT_PAGES)) + ")"))
                words = lambda cond, by: F.array_join(F.transform(F.filter(qs, lambda q: free(q) & cond(q)), lambda q: q["c"]), by)
                headed = F.regexp_extract(head, r"(?s)^.* · (.*)$", 1)
                return F.struct(
                    F.coalesce(X.empty_to_null(last(SHOT_TIME, 6)), headed).alias("ts"),
                    F.coalesce(X.empty_to_null(F.regexp_extract(head, r"(?s)^(.*) · .*$", 1)), head).alias("headline"),
                    words(lambda q: q["i"] < at, "｜").alias("detail"),
                    F.coalesce(X.strip(F.regexp_extract(F.try_element_at(images, F.lit(-1))["s"], r"\]\((.*)\)", 1)), F.lit("")).alias("img"),
                    last(SHOT_NOTE, 4).alias("note"),
                    X.strip(words(lambda q: q["i"] > at, "\n")).alias("text"),
                    note_fields(F.coalesce(F.try_element_at(F.filter(rs, lambda r: r["note"]), F.lit(-1))["s"], F.lit(""))).alias("m"),
                )

            return X.let(text_at, rest)

        return X.let(quoted, fields)

    return X.let(rows, read)


def parse_snapshots(notebooks: DataFrame, key: str = "notebook", md: str = "md") -> DataFrame:
    """Records of snapshot notebooks: image, detail, note, the recognised text, source."""
    r = _blocks(notebooks, key, md, SNAPSHOT_HEAD).withColumn("_r", _snapshot(F.col("_block")))
    c = F.col
    return r.select(
        key, "block_no", *[c(f"_r.{f}").alias(f) for f in ("ts", "headline", "detail", "img", "note", "text")],
        c("_r.m.src").alias("src"), c("_r.m.page").alias("page"), c("_r.m.cite").alias("cite_std"),
        c("_r.m.fn").alias("fn"), c("_r.m.size").alias("size"), c("_r.m.npages").alias("npages"),
    )
