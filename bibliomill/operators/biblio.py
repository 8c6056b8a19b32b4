"""Bibliographic and rights fields from names, folders, texts and colophons."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliomill.functions import names as N
from bibliomill.functions import text as X
from bibliomill.functions.dims import TERMS
from bibliomill.operators.editions import LOOSE_LIMIT
from bibliomill.operators.paging import chosen_pages
from bibliomill.operators.search import contained_terms
from bibliomill.session import cut_lineage

# ---- fixed values: colophon key words with their weights, and patterns ----------------
LINE_WEIGHTS = (
    (6, "图书在版编目|CIP数据"),
    (5, "ISBN|统一书号|书号"),
    (5, "定价|定價"),
    (4, "第[1１一]版|第[1１一]次印刷"),
    (3, "出版|發行|发行|印刷|印制"),
    (3, "印张|印張|开本|開本|字数|字數|印数|印數|插页|插頁"),
    (2, "出版社|印书馆|書局|书局|書社|书社"),
)
STRONG = "定价|定價|统一书号|統一書號|ISBN|第[1１一]次印刷|印数|印數|印张|印張"
WINDOW, BEFORE, AFTER, HEAD_LINES, TAIL_LINES = 12, 22, 24, 30, 50
CIP = (
    r"(?U)([\x{4E00}-\x{9FA5}A-Za-z0-9·、（）()《》〔〕]{2,40})[／/]"
    r"([\x{4E00}-\x{9FA5}A-Za-z0-9·\s]{1,28}?)\s*[.．,，]?\s*[-—－一.．]{1,3}\s*"
    r"([\x{4E00}-\x{9FA5}]{2,4}?)\s*[:：]?\s*"
    r"([\x{4E00}-\x{9FA5}]{2,20}?(?:出版社|印书馆|书局|书社|出版公司))[，,]?\s*((?:19|20)\d{2})"
)
CIP_END = r"(?U)(?:出版社|印书馆|书局|书社|出版公司)[，,]?\s*(?:19|20)\d{2}"
NOT_AN_AUTHOR = "出版社|印书馆|书局|书社|出版公司|书店"
LIGHT_TRAD = "書館學報廣東藝齋華務國義語經點叢屬歸讀寫爲與對輯廠業這圖錄發會"
LIGHT_SIMP = "书馆学报广东艺斋华务国义语经点丛属归读写为与对辑厂业这图录发会"
PUB_LINE = r"^[\x{4E00}-\x{9FA5}]{2,14}(?:出版社|印书馆|书局|书社|出版公司|书店)$"
PUB_SHAPE = r"([\x{4E00}-\x{9FA5}]{2,12}?(?:出版社|印书馆|书局|书社|出版公司))"
PUB_STOP = r"^(?:各|这些|这一|官|私营|如|由|于|在|的|及|与|等|年|第|所|其|该|和|被|设|兼|前|后|原|旧)"
YEAR_RULES = (
    (r"(?U)((?:19|20)\d{2})\s*年?\s*\d{0,2}\s*月?\s*第[1１一]版", 0.85),
    (None, 0.7),
    (r"(?U)((?:19|20)\d{2})\s*年\s*\d{0,2}\s*月", 0.75),
    (r"(?U)((?:19|20)\d{2})\s*年[^\n]{0,20}?(?:出版|印刷)", 0.6),
    (r"(?U)出版[^\n]{0,20}?((?:19|20)\d{2})", 0.5),
)
AUTHORS = (
    r"(?U)([\x{4E00}-\x{9FA5}·]{2,16}(?:[、，,]+[\x{4E00}-\x{9FA5}·]{2,16}){0,3})\s*"
    r"(编著|主编|编选|选编|辑录|校注|校订|点校|纂|著|着|撰|编)"
)
NAME_STOP = "出版|发行|印刷|书店|书局|本社|该|其|以上|以下"
INSTITUTION = (
    "(研究室|委员会|编辑部|编委会|研究所|研究院|办公厅|办公室|大学|学院|出版社|图书馆|档案馆|博物馆|研究会|"
    "省委|市委|县委|部|局|社|馆|会|室|院|系|所|中心)$"
)
TEXT_END = r"^[ 　．。；;，,、）)】\]]*$"
PUBLISHER_LINE = "出版社|印书馆|書局|书局|書社|书社|新华书店|出版发行|出版發行"
VOLUME_ONLY = r"(?U)^第?[一二三四五六七八九十百\d]{0,4}\s*[卷册集部编篇辑]$|^[（(]?[一二三四五六七八九十\d]{1,3}[）)]?$"
NOT_A_TITLE = (
    "出版社|印书馆|書局|书局|書社|书社|新华书店|印刷|发行|發行|经销|經銷|定价|定價|印数|印數|印张|印張|开本|開本|字数|字數|"
    "插页|插頁|编|著|译|譯|室|会|會|院|系|大学|大學|研究所|公司|合编|编委|主编|校订|点校|整理|北京|上海|广州|南京|武汉|成都|"
    "中华民国|民国|历史|近代史|社会科学院"
)
NOT_A_TITLE_END = r"[。，；：！？、　]$|。|，|(?:出版|發行|发行|印刷|印制|印行)$|[0-9]{3,}"
LINES_ABOVE = 15
SCRIPT_TRAD = "書學國會發錄圖這業廠輯對們為與說讀寫歸屬廣語叢經點"
SCRIPT_SIMP = "书学国会发录图这业厂辑对们为与说读写归属广语丛经点"
RIGHTS = (
    ("authorization", r"(?U)(?:据|根據|根据|經|经)?\s*([\x{4E00}-\x{9FA5}A-Za-z0-9·（）()]{2,30}?)\s*(?:獨家授權|独家授权|授權|授权)(?:影印|重印|出版|刊行|發行|发行)?"),
    ("copyright_holder", r"(?U)(?:版權所有|版权所有|著作權所有|著作权所有|版權|版权|著作权|著作權)\s*[:：]?\s*([\x{4E00}-\x{9FA5}A-Za-z0-9·（）()]{2,40})"),
    ("copyright_line", r"(?U)(?:©|\(C\))\s*([\x{4E00}-\x{9FA5}A-Za-z0-9·（）()]{2,40})"),
    ("isbn", r"(?U)ISBN\s*[:：]?\s*([0-9\-xX]{10,20})"),
    ("edition", r"(?U)第\s*([0-9一二三四五六七八九十]{1,3})\s*版"),
    ("printing", r"(?U)第\s*([0-9一二三四五六七八九十]{1,3})\s*次印刷"),
    ("pub_date", r"(?U)((?:19|20)\d{2})\s*年\s*([0-9]{1,2})?\s*月?"),
    ("rights_holder", r"(?U)(?:出版發行|出版发行|出版者|印刷發行|印刷发行)\s*[:：]?\s*([\x{4E00}-\x{9FA5}]{2,25})"),
)
# Strings one of which every match of a pattern contains: where none is, the pattern is not tried.
RIGHTS_LITERALS = {
    "authorization": ("授權", "授权"), "copyright_holder": ("權", "权"), "copyright_line": ("©", "(C)"), "isbn": ("ISBN",),
    "edition": ("版",), "printing": ("次印刷",), "pub_date": ("年",), "rights_holder": ("出版", "印刷"),
}
TOC_STRONG, TOC_WEAK = ("版权页", "版權頁"), ("版权", "版權")
SAMPLE_KEYS = ("ISBN", "出版", "定价", "印刷")
# ---------------------------------------------------------------------------------------

# Characters one of which every key word of a colophon contains: a cheap first test.
ANY_KEY = "[图CI书書定第出發发印开開字插]"

# What a told line holds at least, in a text as it stands: literals are looked for much faster
# than expressions.  Capital letters may be of either width.
KEY_LITERALS = ("图书在版编目", "数据", "ISBN", "书号", "書號", "定价", "定價", "第", "出版", "發行", "发行", "印", "书局", "書局", "书社", "書社",
    "开本", "開本", "字数", "字數", "插页", "插頁")

FIELDS = ("title", "volume", "author", "publisher", "year", "ssid", "city")


def _match(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def line_weight(line: Column) -> Column:
    total = F.lit(0)
    for weight, pattern in LINE_WEIGHTS:
        total = total + F.when(_match(line, pattern), weight).otherwise(0)
    return F.when(F.length(line).between(2, 80) & _match(line, ANY_KEY), total).otherwise(0)


def _rated_lines(lines: Column) -> Column:
    strong = lambda l: F.when(_match(l, ANY_KEY) & _match(l, STRONG), 1).otherwise(0)
    return F.transform(lines, lambda l: F.struct(line_weight(l).alias("w"), strong(l).alias("s")))


def colophon(text: Column) -> Column:
    """``struct<block, at_line>``: the lines around the densest run of colophon words.

    Twelve-line windows are rated by strong lines, then weight, first best wins; without
    any key word the block is the beginning and the end.  All of it happens inside the
    row, no line is shuffled.
    """
    kind = T.StructType.fromDDL("s int, w int, i int")

    def best(rated: Column) -> Column:
        def total(i: Column, field: str) -> Column:
            return F.aggregate(F.slice(rated, i + 1, WINDOW), F.lit(0), lambda a, r: a + r[field])

        # The first window holding any given lines begins eleven lines before the last of
        # them, so only such windows are rated.
        told = F.filter(
            F.transform(rated, lambda r, i: F.when((r["w"] > 0) | (r["s"] > 0), F.greatest(i - (WINDOW - 1), F.lit(0)))),
            lambda i: i.isNotNull(),
        )
        windows = F.transform(
            F.array_distinct(told),
            lambda i: F.struct(total(i, "s").alias("s"), total(i, "w").alias("w"), (-i).alias("i")).cast(kind),
        )
        return F.array_max(windows)

    def head_and_tail(lines: Column) -> Column:
        tail = F.slice(lines, F.greatest(F.size(lines) - TAIL_LINES, F.lit(0)) + 1, TAIL_LINES)
        return F.concat(F.slice(lines, 1, HEAD_LINES), F.array(F.lit("…")), tail)

    def cut(lines: Column, b: Column) -> Column:
        start = F.greatest(-b["i"] - BEFORE, F.lit(0))
        around = F.slice(lines, start + 1, -b["i"] + AFTER - start)
        found = F.coalesce(b["w"] > 0, F.lit(False))
        return F.struct(
            F.array_join(F.when(found, around).otherwise(head_and_tail(lines)), "\n").alias("block"),
            F.when(found, -b["i"]).cast("long").alias("at_line"),
        )

    def beginning_and_end(lines: Column) -> Column:
        ends = X.let(lines, lambda ls: F.transform(F.transform(head_and_tail(ls), X.half_width), X.rstrip))
        return F.struct(F.array_join(ends, "\n").alias("block"), F.lit(None).cast("long").alias("at_line"))

    # Without a key word in either width no line is told and only the ends are read.  Characters
    # that half width drops could stand inside a word or between lines: such texts are read whole.
    literals = [F.contains(text, F.lit(k)) for k in KEY_LITERALS]
    worth = reduce(or_, literals) | _match(text, f"[ＩＳＢＮ]|{X.OCR_JUNK}")
    lines = X.let(X.half_width(text), lambda narrow: F.transform(X.lines(narrow), X.rstrip))
    dense = X.let(lines, lambda ls: X.let(X.let(_rated_lines(ls), best), lambda b: cut(ls, b)))
    return F.when(worth, dense).otherwise(beginning_and_end(X.lines(text)))


def colophons(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add ``block`` and ``at_line`` (:func:`colophon`) to the rows that have any text."""
    d = texts.filter(_match(F.col(text), r"(?U)\S")).withColumn("_c", colophon(F.col(text)))
    return d.withColumn("block", F.col("_c.block")).withColumn("at_line", F.col("_c.at_line")).drop("_c")


def page_scores(pages: DataFrame) -> DataFrame:
    """Strong lines and weight of every page."""
    zero = F.struct(F.lit(0).cast("long").alias("strong"), F.lit(0).cast("long").alias("total"))
    sums = F.aggregate(
        X.let(X.half_width(F.col("text")), lambda narrow: _rated_lines(X.lines(narrow))),
        zero,
        lambda a, r: F.struct((a["strong"] + r["s"]).alias("strong"), (a["total"] + r["w"]).alias("total")),
    )
    d = pages.withColumn("_r", sums)
    return d.withColumn("strong", F.col("_r.strong")).withColumn("total", F.col("_r.total")).drop("_r", "text")


def colophon_page(pages: DataFrame, key: str = "doc_id", front: int = 20, back: int = 15, docs: DataFrame | None = None) -> DataFrame:
    """Best rated of the first and last pages; 0 where none is convincing.  Pages carry
    their document's ``n_pages``, so all others are dropped where they are cut.  ``docs``
    adds the documents that have no page at all, with 0."""
    ends = pages.filter((F.col("ord") < front) | (F.col("ord") >= F.col("n_pages") - back))
    best = page_scores(ends).groupBy(key).agg(
        F.max(F.struct("strong", "total", (-F.col("ord")).alias("o"))).alias("b")
    )
    sure = (F.col("b.strong") >= 1) | (F.col("b.total") >= 6)
    found = best.select(key, F.when(sure, 1 - F.col("b.o")).otherwise(0).alias("colophon_page"))
    if docs is None:
        return found
    return docs.select(key).distinct().join(found, key, "left").select(key, F.coalesce("colophon_page", F.lit(0)).alias("colophon_page"))


def colophon_in_toc(toc: DataFrame, key: str = "doc_id") -> DataFrame:
    """Page of the contents entry naming the colophon, plain words before vague ones."""
    def any_of(words: tuple[str, ...]) -> Column:
        return _match(F.col("title"), "|".join(words))

    tier = F.when(any_of(TOC_STRONG), 0).when(any_of(TOC_WEAK), 1)
    rated = toc.filter("page > 0").withColumn("_tier", tier)
    best = rated.groupBy(key).agg(F.min_by("page", F.when(F.col("_tier").isNotNull(), F.struct("_tier", "pos"))).alias("page"))
    return best.select(key, F.coalesce("page", F.lit(0)).cast("long").alias("page"))


def sampled_pages(pages: DataFrame, key: str = "doc_id", whole: int = 400) -> DataFrame:
    """Pages read for a record: 16 at either end; without any key word there, all pages of
    a book of up to ``whole`` pages, else the first 60 and last 30.  What neither rule reads
    is dropped before the documents' flags are joined."""
    last = F.col("n_pages") - F.col("ord")
    short = (F.col("ord") < 16) | (last <= 16)
    wide = (F.col("n_pages") <= whole) | (F.col("ord") < 60) | (last <= 30)
    word = _match(F.col("text"), "|".join(SAMPLE_KEYS))
    telling = pages.filter(short).groupBy(key).agg(F.bool_or(word).alias("_telling"))
    return pages.filter(short | wide).join(telling, key).filter(short | ~F.col("_telling")).drop("_telling")


def sampled_text_pages(docs: DataFrame, text: str = "text", whole: int = 400) -> DataFrame:
    """The pages :func:`sampled_pages` reads, chosen where a document is cut: the ends of its
    page array tell whether they hold a key word, and only chosen pages become rows."""

    def choose(pages: Column) -> Column:
        n = F.size(pages)
        ends = F.concat(F.slice(pages, 1, 16), F.slice(pages, F.greatest(n - 16, F.lit(0)) + 1, 16))
        telling = F.exists(ends, lambda s: _match(s["text"], "|".join(SAMPLE_KEYS)))
        short = lambda s: (s["ord"] < 16) | (n - s["ord"] <= 16)
        wide = lambda s: (n <= whole) | (s["ord"] < 60) | (n - s["ord"] <= 30)
        return X.let(telling, lambda told: F.filter(pages, lambda s: short(s) | (~told & wide(s))))

    return chosen_pages(docs, choose, text)


# ---- fields of one colophon block -----------------------------------------------------


def cip(block: Column) -> Column:
    """Fields of a cataloguing line as a struct (empty strings without one).

    The line is looked for once, and only where its end stands; its fields are then read from
    the line alone.
    """
    worth = _match(block, "[／/]") & _match(block, CIP_END)
    line = F.when(worth, F.regexp_extract(block, CIP, 0)).otherwise("")

    def fields(g: Column) -> Column:
        plain = F.length(g[1]).between(2, 12) & ~_match(g[1], NOT_AN_AUTHOR) & _match(g[1], r"(?U)^[\x{4E00}-\x{9FA5}·\s]{2,12}$")
        return F.struct(
            g[0].alias("title"), F.when(plain, g[1]).otherwise("").alias("author"), g[2].alias("city"), g[3].alias("publisher"), g[4].alias("year")
        )

    return X.let(line, lambda l: X.let(F.array(*[X.strip(F.regexp_extract(l, CIP, i)) for i in range(1, 6)]), fields))


def year_of(block: Column, cip_year: Column) -> Column:
    """Year and confidence by the first rule that applies."""
    found = []
    for pattern, sure in YEAR_RULES:
        y = X.empty_to_null(cip_year if pattern is None else F.regexp_extract(block, pattern, 1))
        found.append(F.when(y.isNotNull(), F.struct(y.alias("year"), F.lit(sure).alias("sure"))))
    none = F.struct(F.lit("").alias("year"), F.lit(0.0).alias("sure"))
    return F.coalesce(*found, none)


def shaped_publisher(block: Column) -> Column:
    """Most frequent publisher-like string, the longer and then the earlier one on a tie."""
    found = F.filter(
        F.regexp_extract_all(F.translate(block, LIGHT_TRAD, LIGHT_SIMP), F.lit(PUB_SHAPE), F.lit(1)),
        lambda p: (F.length(p) >= 4) & ~_match(p, PUB_STOP),
    )
    rated = F.aggregate(
        F.transform(found, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        F.array().cast("array<struct<n:int,l:int,i:int,p:string>>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda a: a["p"] == x["p"]),
            F.transform(acc, lambda a: F.when(a["p"] == x["p"], F.struct((a["n"] + 1).alias("n"), a["l"], a["i"], a["p"])).otherwise(a)),
        ).otherwise(F.array_append(acc, F.struct(F.lit(1).alias("n"), F.length(x["p"]).alias("l"), (-x["i"]).alias("i"), x["p"].alias("p")))),
    )
    return F.coalesce(F.array_max(rated)["p"], F.lit(""))


def publishers(blocks: DataFrame, dictionary: DataFrame, key: str = "doc_id", limit: int = TERMS) -> DataFrame:
    """Publisher of each block: a dictionary name filling a line, else the longest
    dictionary name inside (the one starting last on a tie), else the most frequent shape."""
    # Two branches read the blocks, which are costly to find: written once.
    blocks = cut_lineage(blocks, "blocks")
    b = blocks.select(key, F.translate("block", LIGHT_TRAD, LIGHT_SIMP).alias("nb"))
    names = dictionary.filter("publisher <> ''").groupBy("publisher").agg(F.min_by("city", "pos").alias("city"))
    hits = contained_terms(b, [key], "nb", names, "publisher", limit)
    own_line = F.concat(F.lit(r"(?Umd)^[^\S\n]*"), X.quoted(F.col("publisher")), F.lit(r"[^\S\n]*$"))
    line_at = F.when(_match(F.col("publisher"), PUB_LINE), F.regexp_instr("nb", own_line))
    best = hits.withColumn("_line", line_at).groupBy(key).agg(
        F.min(F.when(F.col("_line") > 0, F.struct("_line", "publisher", "city"))).alias("_own"),
        F.max(F.struct(F.length("publisher").alias("l"), F.instr("nb", F.col("publisher")).alias("at"), F.col("publisher").alias("publisher"), F.col("city").alias("city"))).alias("_in"),
    )
    d = blocks.join(best, key, "left").withColumn("_shape", shaped_publisher(F.col("block")))
    return d.select(
        *blocks.columns,
        F.coalesce("_own.publisher", "_in.publisher", "_shape").alias("publisher"),
        F.coalesce("_own.city", "_in.city", F.lit("")).alias("city"),
        F.when(F.col("_own").isNotNull(), 0.95).when(F.col("_in").isNotNull(), 0.9).when(F.col("_shape") != "", 0.5).otherwise(0.0).alias("sure"),
    )


def authors_of(block: Column, surnames: str) -> Column:
    """Responsible persons or institutions with their role, of the first phrase naming any."""
    raw = F.regexp_extract_all(block, F.lit(AUTHORS), F.lit(1))
    role = F.regexp_extract_all(block, F.lit(AUTHORS), F.lit(2))
    after = F.slice(F.split(block, AUTHORS, -1), 2, 1 << 30)

    def keep(z: Column) -> Column:
        # A phrase closing the text may name people with an unlisted surname.
        return F.filter(
            F.split(z["raw"], "[、，,]+"),
            lambda n: (n != "")
            & ~_match(n, NAME_STOP)
            & (
                _match(n, INSTITUTION)
                | N.is_person_name(n, surnames)
                | (F.length(n).between(2, 4) & z["last"] & _match(z["after"], TEXT_END))
            ),
        )

    zipped = F.reverse(
        F.transform(
            F.reverse(F.arrays_zip(raw.alias("raw"), role.alias("role"), after.alias("after"))),
            lambda z, i: F.struct(
                z["raw"].alias("raw"),
                F.when(z["role"] == "着", "著").otherwise(z["role"]).alias("role"),
                z["after"].alias("after"),
                (i == 0).alias("last"),
            ),
        )
    )
    named = F.filter(
        F.transform(zipped, lambda z: F.struct(keep(z).alias("names"), z["role"].alias("role"))), lambda z: F.size(z["names"]) > 0
    )
    first = F.get(named, F.lit(0))
    return F.coalesce(F.concat(F.array_join(first["names"], " "), first["role"]), F.lit(""))


def is_title_line(l: Column) -> Column:
    return (
        F.length(l).between(2, 22)
        & _match(l, N.CJK)
        & ~_match(l, NOT_A_TITLE)
        & ~_match(X.compact(l), VOLUME_ONLY)
        & ~_match(l, NOT_A_TITLE_END)
    )


def title_of(block: Column) -> Column:
    """The nearest title-like line above a publisher line (at most fifteen up, publisher
    lines in order), else the first title-like line of the block."""
    rated = F.transform(
        X.lines(block),
        lambda l, i: F.struct(
            X.strip(l).alias("l"), is_title_line(X.strip(l)).alias("ok"), _match(l, PUBLISHER_LINE).alias("pub"), i.alias("i")
        ),
    )

    def choose(ls: Column, ok: Column) -> Column:
        def nearest(p: Column) -> Column:
            above = F.filter(ok, lambda r: (r["i"] < p["i"]) & (r["i"] >= p["i"] - LINES_ABOVE))
            return F.try_element_at(above, F.lit(-1))["l"]

        found = F.filter(F.transform(F.filter(ls, lambda r: r["pub"]), nearest), lambda s: s.isNotNull())
        return F.coalesce(F.get(found, F.lit(0)), F.get(ok, F.lit(0))["l"], F.lit(""))

    return X.let(rated, lambda ls: X.let(F.filter(ls, lambda r: r["ok"]), lambda ok: choose(ls, ok)))


def repeated_line(text: Column, at_least: int = 3) -> Column:
    """Title-like line that a text repeats most, the first one on a tie: equal lines are
    neighbours after sorting, and runs are counted in one pass.  Only lines with such
    characters as a title needs are brought to half width."""
    clean = F.regexp_replace(text, X.OCR_JUNK, "")
    written = X.let(clean, lambda c: F.filter(X.lines(c), lambda l: _match(l, N.CJK)))
    lines = F.transform(written, lambda l: X.strip(X.half_width(l)))
    titles = F.filter(F.transform(lines, lambda l, i: F.struct(l.alias("l"), i.alias("i"))), lambda r: is_title_line(r["l"]))
    run = T.StructType.fromDDL("l string, n int, i int, best struct<n int, i int, l string>")

    def close(a: Column) -> Column:
        ended = F.when(a["n"] >= at_least, F.struct(a["n"].alias("n"), (-a["i"]).alias("i"), a["l"].alias("l")))
        return F.greatest(a["best"], ended.cast(run["best"].dataType))

    def step(a: Column, r: Column) -> Column:
        same = a["l"] == r["l"]
        return F.struct(
            r["l"].alias("l"),
            F.when(same, a["n"] + 1).otherwise(1).alias("n"),
            F.when(same, a["i"]).otherwise(r["i"]).alias("i"),
            F.when(same, a["best"]).otherwise(close(a)).alias("best"),
        ).cast(run)

    start = F.struct(F.lit("").alias("l"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(None).alias("best")).cast(run)
    # two equal titles are needed at least, and most texts have none
    return F.when(_match(text, N.CJK), F.aggregate(F.array_sort(titles), start, step, lambda a: close(a)["l"]))


def trad_share(text: Column) -> Column:
    """Share of traditional forms among the paired characters."""
    def count(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    trad, simp = count(SCRIPT_TRAD), count(SCRIPT_SIMP)
    return F.when(trad + simp > 0, trad / (trad + simp)).otherwise(0.0)


def colophon_fields(texts: DataFrame, dictionary: DataFrame, surnames: str, key: str = "doc_id", limit: int = TERMS) -> DataFrame:
    """``block`` and the fields it tells; the cataloguing line goes before other readings."""
    b = colophons(texts.select(key, "text")).drop("at_line")
    read = F.struct(
        title_of(F.col("block")).alias("title"), cip(F.col("block")).alias("cip"),
        authors_of(F.col("block"), surnames).alias("author"), repeated_line(F.col("text")).alias("again"),
    )
    b = publishers(b.withColumn("_f", read).drop("text"), dictionary, key, limit)
    y = year_of(F.col("block"), F.col("_f.cip.year"))["year"]
    first = lambda *cs: F.coalesce(*[X.empty_to_null(c) for c in cs])
    return b.select(
        key,
        "block",
        first(F.col("_f.cip.title"), F.col("_f.title"), F.col("_f.again")).alias("title"),
        first(F.col("_f.cip.author"), F.col("_f.author")).alias("author"),
        first(F.col("_f.cip.publisher"), F.col("publisher")).alias("publisher"),
        first(F.col("_f.cip.city"), F.col("city")).alias("city"),
        first(F.col("_f.cip.year"), y).alias("year"),
    )


# ---- folders, merge, rights -------------------------------------------------------------


def folder_names(dirs: DataFrame) -> DataFrame:
    """``dir, depth, folder``: names of the parents, nearest first, for distinct ``dirs``."""
    parts = F.filter(F.split("dir", r"[\\/]"), lambda p: p != "")
    return dirs.select("dir").distinct().select("dir", F.posexplode(F.reverse(parts)).alias("depth", "folder"))


def folder_fields(dirs: DataFrame, surnames: str) -> DataFrame:
    """Fields told by the folders of each directory, the nearest first.

    Only the nearest folder, or one written like a record, may give a title; every
    distinct folder name is read once.
    """
    chain = folder_names(dirs).filter(_match(F.col("folder"), N.CJK))
    read = N.parse_names(chain.select("folder").distinct(), surnames, "folder")
    d = chain.join(read, "folder")
    as_title = (F.col("depth") == 0) | _match(F.col("folder"), "[（(：:《]")
    near = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("depth"))).alias(c)
    title = F.min_by("title", F.when(as_title & (F.col("title") != ""), F.col("depth")))
    return d.groupBy("dir").agg(
        F.regexp_replace(title, N.VOLUME_TAIL, "").alias("title"), near("author"), near("publisher"), near("year"), near("volume")
    )


def merged_record(sources: list[tuple[str, dict[str, Column]]], fields: tuple[str, ...] = FIELDS) -> list[Column]:
    """Value and provenance columns: per field the first source that has it."""
    out = []
    for f in fields:
        values = [(tag, X.empty_to_null(cols[f])) for tag, cols in sources if f in cols]
        out.append(F.coalesce(*[v for _, v in values]).alias(f))
        src = F.lit(None).cast("string")
        for tag, v in reversed(values):
            src = F.when(v.isNotNull(), tag).otherwise(src)
        out.append(src.alias(f"{f}_src"))
    return out


def deep_records(
    files: DataFrame, text_fields: DataFrame, pdf_fields: DataFrame | None, dictionary: DataFrame, surnames: str
) -> DataFrame:
    """Record of each file from four sources: its name, its folders, the colophon of a
    sibling text, that of a sibling PDF; the city may still come from the dictionary.

    Both frames are :func:`colophon_fields` results keyed by ``dir, name`` of the file the text
    belongs to, one row a file; they may come as one, as the name tells the format.  Siblings
    are chosen as :func:`editions.sibling` does, but their fields travel with them: each
    family and each loose family is reduced once, for both formats, to the fields of its best
    member.
    """
    told = [c for c in FIELDS if c not in ("volume", "ssid")]
    formats = {"txt": (".txt", ".text"), "pdf": (".pdf",)}
    fields = text_fields if pdf_fields is None else text_fields.unionByName(pdf_fields, allowMissingColumns=True)
    # Of a colophon only its fields and its script are kept.  Extraction is costly and three
    # branches read these narrow rows: written once.
    read = fields.filter(F.coalesce(*[F.col(c) for c in told]).isNotNull()).select(
        "dir", "name", F.struct("name", *told, (trad_share(F.col("block")) >= 0.5).alias("trad")).alias("_told")
    )
    conv = F.when(F.rlike("name", F.lit("[繁简]转[繁简]")), 1).otherwise(0)
    f = N.parse_names(files.select("dir", "name"), surnames).withColumn("fk", N.family_key(F.col("name")))
    f = f.withColumn("lk", N.loose_key(F.col("fk"))).withColumn("_conv", conv)
    f = f.join(cut_lineage(read, "colophon-fields"), ["dir", "name"], "left")

    telling = {tag: F.when(F.col("ext").isin(*exts) & F.col("_told").isNotNull(), F.struct("_conv", "_told")) for tag, exts in formats.items()}
    named = f.filter("fk <> ''")
    family = named.groupBy("dir", "fk").agg(*[F.min(t).alias(f"_{tag}_best") for tag, t in telling.items()])
    few = {tag: F.count_if(F.col("ext").isin(*exts)) <= LOOSE_LIMIT for tag, exts in formats.items()}
    loose = named.filter("lk <> ''").groupBy("dir", "lk").agg(*[F.when(few[tag], F.min(t)).alias(f"_{tag}_loose") for tag, t in telling.items()])
    d = f.join(family, ["dir", "fk"], "left").join(loose, ["dir", "lk"], "left")
    for tag, own in telling.items():
        best = F.col(f"_{tag}_best")
        chosen = F.when((F.col("fk") != "") & (own["_conv"] <= best["_conv"]), own).otherwise(best)
        d = d.withColumn(tag, F.coalesce(chosen, F.col(f"_{tag}_loose"))["_told"])

    folder = folder_fields(files, surnames).select("dir", F.struct("title", "author", "publisher", "year", "volume").alias("_folder"))
    d = d.join(folder, "dir", "left")
    col = F.col
    sources = [
        ("file", {c: col(c) for c in ("title", "volume", "author", "publisher", "year", "ssid")}),
        ("folder", {c: col(f"_folder.{c}") for c in ("title", "volume", "author", "publisher", "year")}),
        ("txt", {c: col(f"txt.{c}") for c in told}),
        ("pdf", {c: col(f"pdf.{c}") for c in told}),
    ]
    trad = col("trad") | _match(col("dir"), "繁[体體]") | F.coalesce("txt.trad", "pdf.trad", F.lit(False))
    d = d.select("dir", "name", "ext", "tail", trad.alias("trad"), col("txt.name").alias("txt_file"), *merged_record(sources))
    cities = dictionary.groupBy("publisher").agg(F.min_by("city", "pos").alias("_city"))
    d = d.join(cities, "publisher", "left")
    known = col("city").isNotNull() | col("_city").isNull()
    return d.withColumn("city_src", F.when(known, col("city_src")).otherwise("dict")).withColumn("city", F.coalesce("city", "_city")).drop("_city")


def rights_columns(t: Column) -> list[Column]:
    """The eight rights fields of one text in half width; NULL where it does not tell."""
    out = []
    for field, pattern in RIGHTS:
        told = reduce(or_, [F.contains(t, F.lit(k)) for k in RIGHTS_LITERALS[field]])
        v = F.when(told, F.regexp_extract(t, pattern, 1))
        if field == "isbn":
            v = F.upper(v)
            v = F.when(F.length(v) >= 10, v)
        elif field == "pub_date":
            month = F.regexp_extract(t, pattern, 2)
            v = F.when(v != "", F.concat(v, F.when(month != "", F.concat(F.lit("年"), month, F.lit("月"))).otherwise("年")))
        else:
            v = X.strip_chars(v, " :：")
            v = F.when(F.length(v) >= (1 if field in ("edition", "printing") else 2), v)
        out.append(v.alias(field))
    return out


def rights(texts: DataFrame, key: list[str]) -> DataFrame:
    """Rights fields per item from ``(key, source_rank, source, text)`` rows: the name, the
    folders from near to far, the colophon; with the source of every field."""
    # the text is brought to half width once, not once for every field
    read = X.let(X.half_width(F.col("text")), lambda t: F.struct(*rights_columns(t)))
    d = texts.select(*key, "source_rank", "source", read.alias("_r")).select(*key, "source_rank", "source", *[f"_r.{f}" for f, _ in RIGHTS])
    aggs = []
    for field, _ in RIGHTS:
        rank = F.when(F.col(field).isNotNull(), F.col("source_rank"))
        aggs += [F.min_by(field, rank).alias(field), F.min_by("source", rank).alias(f"{field}_src")]
    return d.groupBy(*key).agg(*aggs)


def citation(title: Column, volume: Column, author: Column, publisher: Column, city: Column, year: Column, page: Column) -> Column:
    """Author：《Title》volume，place：publisher，year，page."""
    e = lambda c: F.coalesce(c, F.lit(""))
    vol = e(volume)
    bare = X.strip_chars(vol, "（）()")
    shown = F.when((vol != "") & F.contains(e(title), bare), "").otherwise(vol)
    tail = F.concat(e(city), F.lit("："), e(publisher), F.lit("，"), e(year), F.lit("年"))
    for old, new in (("：，", "："), ("：年", ""), ("，年", "年")):
        tail = F.replace(tail, F.lit(old), F.lit(new))
    told = (e(publisher) != "") | (e(city) != "") | (e(year) != "")
    s = F.concat(
        e(author), F.lit("：《"), e(title), F.lit("》"), shown,
        F.when(told, F.concat(F.lit("，"), X.strip_chars(tail, "，"))).otherwise(""),
        F.lit("，第"), F.coalesce(X.empty_to_null(page), F.lit("X")), F.lit("页。"),
    )
    for old, new in (("， ，", "，"), ("，：", "："), ("，年", "")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.replace(F.regexp_replace(s, "，+", "，"), F.lit("，。"), F.lit("。"))


# ---- provenance lines and notes -------------------------------------------------------------


def version_label(path: Column, trad: Column) -> Column:
    e = X.ext(X.basename(path))
    return (
        F.when(e == ".pdf", "PDF原本")
        .when(
            e.isin(".txt", ".text"),
            F.when(F.contains(X.basename(path), F.lit("繁转简")), "繁转简TXT").when(trad, "繁体TXT").otherwise("TXT文本"),
        )
        .otherwise(F.upper(F.coalesce(X.empty_to_null(F.ltrim(e, F.lit("."))), F.lit("文本"))))
    )


def provenance(title: Column, volume: Column, author: Column, publisher: Column, year: Column, trad: Column, page: Column, path: Column) -> list[Column]:
    """``headline`` and ``detail`` naming book, volume, page, version, imprint and file."""
    e = lambda c: F.coalesce(c, F.lit(""))
    book = F.coalesce(X.empty_to_null(title), X.empty_to_null(X.stem(X.basename(path))), F.lit("未命名"))
    no = page.try_cast("long")
    page_text = F.when(no > 0, F.concat(F.lit("第"), no.cast("string"), F.lit("页"))).otherwise("页码未定")
    imprint = F.concat(e(publisher), F.when(e(year) != "", F.concat(F.lit("·"), year, F.lit("年"))).otherwise(""))
    label = version_label(path, F.coalesce(trad, F.lit(False)))
    detail = F.concat_ws(
        "｜", X.empty_to_null(author), F.concat(F.lit("版本："), label), X.empty_to_null(imprint),
        F.when(e(path) != "", F.concat(F.lit("文件："), X.basename(path))),
    )
    return [F.concat(F.lit("《"), book, F.lit("》"), e(volume), page_text).alias("headline"), detail.alias("detail")]
