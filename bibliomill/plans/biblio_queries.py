"""Bibliographic, rights and edition queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliomill.functions import names as N
from bibliomill.functions import text as X
from bibliomill.operators import biblio as B
from bibliomill.operators import editions as E
from bibliomill.operators import paging as P
from bibliomill.plans.catalog_queries import EXT, STEM
import bibliomill.plans.inputs  # noqa: F401  the derived inputs
from bibliomill.plans.registry import Tables, oracle, query

SINGLE_SURNAMES = "郑李王冯张邓"
COMPOUND_SURNAMES = ("欧阳", "司马", "诸葛", "上官")
SURNAMES = " ".join((SINGLE_SURNAMES, *COMPOUND_SURNAMES))
WS = "[\\s\\p{Z}]"
HAN = "[\\x{4E00}-\\x{9FA5}]"
BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"


def sub(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{by}', 'g')"


def strip(expr: str) -> str:
    return sub(expr, f"^{WS}+|{WS}+$")


def half(expr: str) -> str:
    wide = X._WIDE_ALNUM + X.WIDE_PUNCTUATION
    narrow = X._NARROW_ALNUM + X.NARROW_PUNCTUATION
    return sub(f"translate({expr}, '{wide}', '{narrow}')", X.OCR_JUNK)


NOISE = f"(?i)(ocr{WS}*优化|ocr优化版|orpalis{WS}*优化|orp{WS}*优化|zhelper[-\\s]?search|zhelper|(?:pd[a-z]{{0,2}}[0-9]*)?(?:ai)?f?ocr|layered|result|unlocked|清晰扫描版|扫描版|【?{WS}*(?:繁转简|简转繁|繁转繁){WS}*】?|纯文本|可搜索版|opt)"
PRODUCT = "(?i)[（(【\\[](?:opt|优化版|优化|压缩版|压缩)[）)】\\]]|[\\s_\\-—+](?:opt|优化版|优化|压缩版|压缩)([\\s_\\-—+（(【\\[]|$|\\.)"
OPT = "(?i)[\\s_\\-—+]*opt([\\s_\\-—+（(【\\[]|$|\\.)"
CONVERTED = "【(?:繁转简|简转繁|繁转繁)】|[_\\-—](?:繁转简|简转繁|繁转繁)"
TAIL = "[（(][^（）()]*(?:出版社|印书馆|书局|书社|出版公司|编著|主编|著|译|[12][09][0-9]{2})[^（）()]*[)）][\\s\\p{Z}_\\-—+·、]*$"
ID = "(^|[^0-9])[0-9]{6,10}([^0-9]|$)"
SEP = "[\\s\\p{Z}_\\-—+·、]+"
EMPTY = f"[（(]{WS}*[)）]"


def core_sql(stem: str) -> str:
    s = sub(sub(sub(sub(stem, f"【{WS}*繁[体體]{WS}*】"), NOISE), PRODUCT, "\\1"), EMPTY)
    for _ in range(2):
        s = strip(sub(sub(s, SEP + "$"), TAIL))
    s = sub(sub(s, ID, "\\1\\2"), "[\\s\\p{Z}_\\-—+·]+", " ")
    return strip(f"trim({s}, '{N.EDGE}')")


def same_key_sql(stem: str) -> str:
    s = sub(sub(half(stem), OPT, "\\1"), PRODUCT, "\\1")
    return f"lower({strip(sub(sub(s, '[\\s\\p{Z}_\\-—+·、.]+$'), '^[\\s\\p{Z}_\\-—+·、]+'))})"


def shell_sql(stem: str) -> str:
    s = sub(sub(sub(sub(half(stem), NOISE), PRODUCT, "\\1"), OPT, "\\1"), CONVERTED)
    s = sub(s, "(?i)[\\s_\\-—+]*(?:pd[a-z]{0,2}[0-9]*)?(?:ai)?f?ocr[\\s_\\-—+]*")
    return f"trim({sub(sub(s, EMPTY), SEP + '$')}, '{N.EDGE}')"


def family_sql(stem: str) -> str:
    return f"lower({sub(shell_sql(stem), '[\\s\\p{Z}_\\-—+·、.,，;；:：\\[\\]【】（）()「」『』]+')})"


def series_sql(core: str) -> str:
    s = sub(core, "[（(][^（）()]*[)）]")
    s = sub(sub(s, f"第{WS}*[0-9一二三四五六七八九十百千]{{1,4}}{WS}*[册卷集部编篇辑期]"), f"全{WS}*[0-9一二三四五六七八九十]{{1,3}}{WS}*册")
    s = f"trim({sub(s, '[\\s\\p{Z}_\\-—+·、.]+', ' ')}, '{N.EDGE}')"
    return f"CASE WHEN regexp_matches({s}, '^{HAN}{{2,}}') THEN regexp_extract({s}, '^{HAN}{{2,}}') ELSE {s} END"


STEMS = f"SELECT *, {STEM} AS stem, {EXT} AS ext FROM {{v_catalog}}"
CORES = f"SELECT *, {core_sql('stem')} AS core FROM st"
KEYS = f"SELECT *, {family_sql('stem')} AS fk, {same_key_sql('stem')} AS sk, {shell_sql('stem')} AS shell FROM cr"
NAMES = dict(st=STEMS, cr=CORES, ky=KEYS)


@query(
    "bib_01_04_title_keys",
    oracle(f"SELECT dir, name, core, sk AS same_key, shell, fk AS family, {series_sql('core')} AS series FROM ky", **NAMES),
)
def _title_keys(t: Tables) -> DataFrame:
    c = F.col("name")
    return t.v_catalog.select(
        "dir", "name", N.book_core(c).alias("core"), N.same_name_key(c).alias("same_key"), N.book_shell(c).alias("shell"),
        N.family_key(c).alias("family"), N.series_prefix(c).alias("series"),
    )


@query(
    "bib_04_families",
    oracle(
        """SELECT dir, fk AS family, CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (WHERE ext = '.pdf') AS BIGINT) AS pdfs,
        CAST(count(*) FILTER (WHERE ext = '.txt') AS BIGINT) AS texts, CAST(sum(size) AS BIGINT) AS bytes, min(name) AS first_name FROM ky GROUP BY dir, fk""",
        **NAMES,
    ),
)
def _families(t: Tables) -> DataFrame:
    return E.families(t.v_catalog)


def parsed_sql(stem: str, core: str) -> str:
    vol = f"第{WS}*([一二三四五六七八九十百千0-9]{{1,4}}){WS}*([册卷集部编篇辑期])|[（(]{WS}*([上下中一二三四五六七八九十]{{1,3}}){WS}*[)）]"
    lead = f"^{WS}*({HAN}{{2,4}})[：:]{WS}*"
    author = f"regexp_extract({stem}, '(?:^|[\\s\\p{{Z}}_·、,，])({HAN}{{2,4}}?)(?:编著|主编|著|撰|编|译|校注|校|辑|注|选辑)', 1)"
    return f"""
CASE WHEN regexp_extract({stem}, '{vol}', 1) <> '' THEN '第' || regexp_extract({stem}, '{vol}', 1) || regexp_extract({stem}, '{vol}', 2)
  WHEN regexp_extract({stem}, '{vol}', 3) <> '' THEN '（' || regexp_extract({stem}, '{vol}', 3) || '）'
  WHEN regexp_matches({stem}, '全{WS}*[0-9一二三四五六七八九十]{{1,3}}{WS}*册') THEN '全' || regexp_extract({stem}, '全{WS}*([0-9一二三四五六七八九十]{{1,3}}){WS}*册', 1) || '册'
  ELSE '' END AS volume,
regexp_extract({stem}, '(?:^|[^0-9])([0-9]{{6,10}})(?:[^0-9]|$)', 1) AS ssid,
regexp_extract({stem}, '({HAN}{{2,18}}(?:大学出版社|出版社|印书馆|书局|书社|出版公司))', 1) AS publisher,
coalesce(regexp_extract_all({stem}, '(?:^|[^0-9])(1[89][0-9]{{2}}|20[0-9]{{2}})(?:[^0-9]|$)', 1)[-1], '') AS year,
CASE WHEN {author} <> '' AND contains('{SINGLE_SURNAMES}', substr({author}, 1, 1)) THEN {author} ELSE regexp_extract({core}, '{lead}', 1) END AS author,
{strip(sub(core, lead))} AS title, CASE WHEN contains({stem}, '繁转简') THEN '_【繁转简】' ELSE '' END AS tail"""


PARSED = f"SELECT doc_id, root, dir, name, ext, size, {parsed_sql('stem', 'core')} FROM cr"


@query(
    "bib_05_name_fields",
    oracle("SELECT dir, name, title, volume, author, publisher, year, ssid, tail FROM pa", **NAMES, pa=PARSED),
)
def _name_fields(t: Tables) -> DataFrame:
    p = N.parse_names(t.v_catalog.select("dir", "name"), SURNAMES)
    return p.select("dir", "name", "title", "volume", "author", "publisher", "year", "ssid", "tail")


# Directories written like records, two levels deep, from the key of each document.
FOLDERS = """
SELECT DISTINCT '/data/' || CASE doc_id % 3 WHEN 0 THEN '李泽厚：美学' || CAST(doc_id % 200 AS STRING) || '（全3册）（北京 文物出版社1981年）'
    WHEN 1 THEN '王某编_黄山书社' || CAST(1950 + doc_id % 60 AS STRING) || '年' ELSE 'plain' || CAST(doc_id % 100 AS STRING) END
  || '/' || CASE doc_id % 4 WHEN 0 THEN 'Temp' WHEN 1 THEN '第' || CAST(doc_id % 9 AS STRING) || '卷' ELSE '卷宗' || CAST(doc_id % 30 AS STRING) || '（第2册）' END AS dir
FROM {documents}"""


@query(
    "bib_06_folder_fields",
    oracle(
        f"""
SELECT dir, {strip(sub("coalesce(arg_min(title, depth) FILTER (WHERE title <> '' AND (depth = 0 OR regexp_matches(folder, '[（(：:《]'))), '')", f"[（(]{WS}*(?:全{WS}*[0-9一二三四五六七八九十]{{1,3}}{WS}*册|第{WS}*[0-9一二三四五六七八九十]{{1,4}}{WS}*[册卷集部编篇辑]){WS}*[）)]{WS}*$"))} AS title,
  coalesce(arg_min(author, depth) FILTER (WHERE author <> ''), '') AS author, coalesce(arg_min(publisher, depth) FILTER (WHERE publisher <> ''), '') AS publisher,
  coalesce(arg_min(year, depth) FILTER (WHERE year <> ''), '') AS year, coalesce(arg_min(volume, depth) FILTER (WHERE volume <> ''), '') AS volume
FROM pf GROUP BY dir""",
        fo=FOLDERS,
        ch="SELECT dir, unnest(list_reverse(l)) AS folder, unnest(range(len(l))) AS depth FROM (SELECT dir, list_filter(string_split(dir, '/'), lambda x: x <> '') AS l FROM fo)",
        fs=f"SELECT ch.*, {STEM.replace('name', 'folder')} AS stem FROM ch WHERE regexp_matches(folder, '{HAN}')",
        fc=f"SELECT *, {core_sql('stem')} AS core FROM fs",
        pf=f"SELECT dir, folder, depth, {parsed_sql('stem', 'core')} FROM fc",
    ),
)
def _folder_fields(t: Tables) -> DataFrame:
    return B.folder_fields(t.sql(FOLDERS), SURNAMES).na.fill("")


WEIGHT = "CASE WHEN length(l) BETWEEN 2 AND 80 THEN " + " + ".join(
    f"CASE WHEN regexp_matches(l, '{p}') THEN {w} ELSE 0 END" for w, p in B.LINE_WEIGHTS
) + " ELSE 0 END"
LINES = dict(
    tx=f"SELECT doc_id, regexp_replace({half('text')}, '(?:{BREAK})$', '') AS t FROM {{v_colophon}}",
    ln=f"""SELECT doc_id, i, {sub('l', WS + '+$')} AS l FROM (SELECT doc_id, unnest(a) AS l, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split_regex(t, '{BREAK}') AS a FROM tx))""",
    wt=f"SELECT *, {WEIGHT} AS w, CASE WHEN regexp_matches(l, '{B.STRONG}') THEN 1 ELSE 0 END AS s FROM ln",
    wn="SELECT doc_id, i, sum(w) OVER x AS tw, sum(s) OVER x AS ts FROM wt WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)",
    be="SELECT doc_id, i AS bi, tw FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, tw DESC, i) AS rn FROM wn) WHERE rn = 1",
    bl="""
SELECT ln.doc_id, string_agg(l, chr(10) ORDER BY i) AS block, any_value(bi) AS bi FROM ln JOIN be USING (doc_id) WHERE tw > 0 AND i >= greatest(bi - 22, 0) AND i < bi + 24 GROUP BY ln.doc_id
UNION ALL SELECT doc_id, string_agg(l, chr(10) ORDER BY o, i), NULL FROM (
  SELECT ln.doc_id, 0 AS o, i, l FROM ln JOIN be USING (doc_id) WHERE tw <= 0 AND i < 30
  UNION ALL SELECT doc_id, 1, 0, '…' FROM be WHERE tw <= 0
  UNION ALL SELECT ln.doc_id, 2, i, l FROM ln JOIN be USING (doc_id) JOIN (SELECT doc_id, max(i) + 1 AS n FROM ln GROUP BY 1) USING (doc_id) WHERE tw <= 0 AND i >= n - 50) GROUP BY doc_id""",
)


def blocks(t: Tables) -> DataFrame:
    return B.colophons(t.v_colophon.select("doc_id", "text")).drop("text")


@query(
    "bib_07_colophon_blocks",
    oracle("SELECT doc_id, md5(block) AS digest, CAST(bi AS BIGINT) AS at_line FROM bl", **LINES),
)
def _colophon_blocks(t: Tables) -> DataFrame:
    return blocks(t).select("doc_id", F.md5("block").alias("digest"), "at_line")


def colophon_pages(t: Tables) -> DataFrame:
    return P.text_pages(t.v_colophon.select("doc_id", "text"), with_total=True)


PAGED = dict(
    pg="SELECT doc_id, i AS ord, substr(text, i * 500 + 1, 500) AS t, n FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT doc_id, text, CAST(ceil(length(text) / 500.0) AS BIGINT) AS n FROM {v_colophon}))",
)


@query(
    "bib_08_colophon_page",
    oracle(
        f"""
SELECT doc_id, CAST(CASE WHEN s >= 1 OR w >= 6 THEN ord + 1 ELSE 0 END AS BIGINT) AS colophon_page FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, w DESC, ord) AS rn FROM (
    SELECT doc_id, ord, sum(CASE WHEN regexp_matches(l, '{B.STRONG}') THEN 1 ELSE 0 END) AS s, sum({WEIGHT}) AS w
    FROM (SELECT doc_id, ord, unnest(string_split_regex(regexp_replace({half('t')}, '(?:{BREAK})$', ''), '{BREAK}')) AS l FROM pg WHERE ord < 20 OR ord >= n - 15) GROUP BY 1, 2)) WHERE rn = 1""",
        **PAGED,
    ),
)
def _colophon_page(t: Tables) -> DataFrame:
    got = B.colophon_page(colophon_pages(t))
    return got.select("doc_id", F.col("colophon_page").cast("long").alias("colophon_page"))


TOC = """
SELECT doc_id % 700 AS doc_id, doc_id AS pos, CASE doc_id % 11 WHEN 0 THEN '版权说明' WHEN 1 THEN '书末版權頁' WHEN 2 THEN ' 版权 ' ELSE lang END AS title,
  CAST(doc_id % 23 AS BIGINT) AS page FROM {documents}"""


@query(
    "bib_09_colophon_in_contents",
    oracle(
        """SELECT doc_id, CAST(coalesce(arg_min(page, CASE WHEN regexp_matches(title, '版权页|版權頁') THEN pos ELSE pos + 1000000000 END)
        FILTER (WHERE regexp_matches(title, '版权|版權')), 0) AS BIGINT) AS page FROM toc WHERE page > 0 GROUP BY doc_id""",
        toc=TOC,
    ),
)
def _in_toc(t: Tables) -> DataFrame:
    return B.colophon_in_toc(t.sql(TOC))


CIP = f"([\\x{{4E00}}-\\x{{9FA5}}A-Za-z0-9·、（）()《》〔〕]{{2,40}})[／/]([\\x{{4E00}}-\\x{{9FA5}}A-Za-z0-9·\\s]{{1,28}}?)\\s*[.．,，]?\\s*[-—－一.．]{{1,3}}\\s*({HAN}{{2,4}}?)\\s*[:：]?\\s*({HAN}{{2,20}}?(?:出版社|印书馆|书局|书社|出版公司))[，,]?\\s*((?:19|20)[0-9]{{2}})"
CIPS = f"SELECT doc_id, block, regexp_extract(block, '{CIP}', 1) AS title, regexp_extract(block, '{CIP}', 2) AS au, regexp_extract(block, '{CIP}', 3) AS city, regexp_extract(block, '{CIP}', 4) AS publisher, regexp_extract(block, '{CIP}', 5) AS year FROM bl"
CIPS2 = f"SELECT doc_id, block, title, CASE WHEN regexp_matches(au, '^[\\x{{4E00}}-\\x{{9FA5}}·\\s]{{2,12}}$') AND NOT regexp_matches(au, '{B.NOT_AN_AUTHOR}') THEN trim(au) ELSE '' END AS author, city, publisher, year FROM cp0"


@query(
    "bib_10_cataloguing_line",
    oracle("SELECT doc_id, title, author, city, publisher, year FROM cp", **LINES, cp0=CIPS, cp=CIPS2),
)
def _cip(t: Tables) -> DataFrame:
    return blocks(t).select("doc_id", B.cip(F.col("block")).alias("c")).select("doc_id", "c.*")


SHAPE = f"({HAN}{{2,12}}?(?:出版社|印书馆|书局|书社|出版公司))"
PUBS = dict(
    di="SELECT publisher, arg_min(city, pos) AS city FROM {v_publishers} GROUP BY publisher",
    nb=f"SELECT doc_id, translate(block, '{B.LIGHT_TRAD}', '{B.LIGHT_SIMP}') AS nb FROM bl",
    own=f"""SELECT doc_id, arg_min(publisher, i) AS publisher, arg_min(city, i) AS city FROM (
  SELECT doc_id, {strip('l')} AS l, i FROM (SELECT doc_id, unnest(a) AS l, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split(nb, chr(10)) AS a FROM nb))) x
  JOIN di ON di.publisher = x.l WHERE regexp_matches(x.l, '{B.PUB_LINE}') GROUP BY doc_id""",
    ins="SELECT doc_id, arg_max(publisher, length(publisher) * 1000000 + instr(nb, publisher)) AS publisher, arg_max(city, length(publisher) * 1000000 + instr(nb, publisher)) AS city FROM nb JOIN di ON contains(nb, publisher) GROUP BY doc_id",
    sh=f"""SELECT doc_id, arg_max(p, n * 100000000 + length(p) * 1000000 - i) AS publisher FROM (SELECT doc_id, p, count(*) AS n, min(i) AS i FROM (
  SELECT doc_id, unnest(a) AS p, unnest(range(len(a))) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(nb, '{SHAPE}'), lambda p: length(p) >= 4 AND NOT regexp_matches(p, '{B.PUB_STOP}')) AS a FROM nb)) GROUP BY doc_id, p) GROUP BY doc_id""",
    pb="""SELECT nb.doc_id, coalesce(own.publisher, ins.publisher, sh.publisher, '') AS publisher, coalesce(own.city, ins.city, '') AS city,
  CASE WHEN own.publisher IS NOT NULL THEN 0.95 WHEN ins.publisher IS NOT NULL THEN 0.9 WHEN sh.publisher IS NOT NULL THEN 0.5 ELSE 0 END AS sure
FROM nb LEFT JOIN own USING (doc_id) LEFT JOIN ins USING (doc_id) LEFT JOIN sh USING (doc_id)""",
)
PUBS_SELECT = "SELECT doc_id, publisher, city, CAST(sure * 100 AS BIGINT) AS sure FROM pb"


@query("bib_11_publishers", oracle(PUBS_SELECT, **LINES, **PUBS))
def _publishers(t: Tables) -> DataFrame:
    got = B.publishers(blocks(t), t.v_publishers)
    return got.select("doc_id", "publisher", "city", F.round(F.col("sure") * 100).cast("long").alias("sure"))


@query("bib_11_publishers_large_dictionary", oracle(PUBS_SELECT, **LINES, **PUBS))
def _publishers_large(t: Tables) -> DataFrame:
    got = B.publishers(blocks(t), t.v_publishers, limit=2)
    return got.select("doc_id", "publisher", "city", F.round(F.col("sure") * 100).cast("long").alias("sure"))


def year_sql(block: str, cip: str) -> str:
    rules = []
    for p, sure in B.YEAR_RULES:
        y = f"nullif({cip}, '')" if p is None else f"nullif(regexp_extract({block}, '{p.replace('(?U)', '').replace('\\s', WS).replace('\\d', '[0-9]')}', 1), '')"
        rules.append((y, sure))
    year = "coalesce(" + ", ".join(y for y, _ in rules) + ", '')"
    sure = "CASE " + " ".join(f"WHEN {y} IS NOT NULL THEN {round(s * 100)}" for y, s in rules) + " ELSE 0 END"
    return f"{year} AS year, CAST({sure} AS BIGINT) AS sure"


@query(
    "bib_12_years",
    oracle(f"SELECT doc_id, {year_sql('block', 'year')} FROM cp", **LINES, cp0=CIPS, cp=CIPS2),
)
def _years(t: Tables) -> DataFrame:
    b = blocks(t).withColumn("y", B.year_of(F.col("block"), B.cip(F.col("block"))["year"]))
    return b.select("doc_id", "y.year", F.round(F.col("y.sure") * 100).cast("long").alias("sure"))


PARTY = B.AUTHORS.replace("(?U)", "").replace("\\s", WS)
COMPOUND = ", ".join(f"'{c}'" for c in COMPOUND_SURNAMES)
PERSON = (
    f"length(nm) BETWEEN 2 AND 4 AND regexp_matches(nm, '^[\\x{{4E00}}-\\x{{9FFF}}]+$') "
    f"AND (substr(nm, 1, 2) IN ({COMPOUND}) OR contains('{SINGLE_SURNAMES}', substr(nm, 1, 1)))"
)
PARTIES = dict(
    ph=f"""SELECT doc_id, unnest(range(len(r))) AS i, len(r) AS n, unnest(r) AS raw, unnest(o) AS role, ends FROM (
  SELECT doc_id, regexp_extract_all(block, '{PARTY}', 1) AS r, regexp_extract_all(block, '{PARTY}', 2) AS o, string_split_regex(block, '{PARTY}')[-1] AS ends FROM bl)""",
    kn=f"""SELECT doc_id, i, role, string_agg(nm, ' ' ORDER BY k) AS names FROM (
  SELECT *, unnest(l) AS nm, unnest(range(len(l))) AS k FROM (SELECT *, string_split_regex(raw, '[、，,]+') AS l FROM ph))
WHERE nm <> '' AND NOT regexp_matches(nm, '{B.NAME_STOP}') AND (regexp_matches(nm, '{B.INSTITUTION}') OR ({PERSON})
  OR (length(nm) BETWEEN 2 AND 4 AND i = n - 1 AND regexp_matches(ends, '{B.TEXT_END}'))) GROUP BY doc_id, i, role""",
    au="SELECT b.doc_id, coalesce(arg_min(names || replace(role, '着', '著'), i), '') AS authors FROM (SELECT DISTINCT doc_id FROM bl) b LEFT JOIN kn ON kn.doc_id = b.doc_id GROUP BY b.doc_id",
)


@query("bib_13_responsible_parties", oracle("SELECT doc_id, authors FROM au", **LINES, **PARTIES))
def _authors(t: Tables) -> DataFrame:
    return blocks(t).select("doc_id", B.authors_of(F.col("block"), SURNAMES).alias("authors"))


OK = f"""length(l) BETWEEN 2 AND 22 AND regexp_matches(l, '{HAN}') AND NOT regexp_matches(l, '{B.NOT_A_TITLE}')
 AND NOT regexp_matches({sub('l', WS + '+')}, '^第?[一二三四五六七八九十百0-9]{{0,4}}[卷册集部编篇辑]$|^[（(]?[一二三四五六七八九十0-9]{{1,3}}[）)]?$') AND NOT regexp_matches(l, '{B.NOT_A_TITLE_END}')"""
TITLES = dict(
    bx=f"SELECT doc_id, i, l, {OK} AS ok, regexp_matches(l, '{B.PUBLISHER_LINE}') AS pub FROM (SELECT doc_id, {strip('l')} AS l, i FROM (SELECT doc_id, unnest(a) AS l, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split(block, chr(10)) AS a FROM bl)))",
    ab="SELECT p.doc_id, p.i AS pi, arg_max(o.l, o.i) AS l FROM bx p JOIN bx o ON o.doc_id = p.doc_id AND o.ok AND o.i < p.i AND o.i >= p.i - 15 WHERE p.pub GROUP BY 1, 2",
    tt="""SELECT b.doc_id, coalesce((SELECT arg_min(l, pi) FROM ab WHERE ab.doc_id = b.doc_id), (SELECT arg_min(l, i) FROM bx WHERE bx.doc_id = b.doc_id AND ok), '') AS title FROM (SELECT DISTINCT doc_id FROM bl) b""",
)


@query("bib_14_titles", oracle("SELECT doc_id, title FROM tt", **LINES, **TITLES))
def _titles(t: Tables) -> DataFrame:
    return blocks(t).select("doc_id", B.title_of(F.col("block")).alias("title"))


@query(
    "bib_14_repeated_titles",
    oracle(
        f"""SELECT doc_id, coalesce(title, '') AS title FROM {{documents}} LEFT JOIN (SELECT doc_id, arg_max(l, n * 1000000 - i) AS title FROM (SELECT doc_id, l, count(*) AS n, min(i) AS i FROM (
        SELECT doc_id, {strip('l')} AS l, i FROM ln) WHERE {OK} GROUP BY doc_id, l HAVING count(*) >= 3) GROUP BY doc_id) USING (doc_id)""",
        **LINES,
    ),
)
def _repeated(t: Tables) -> DataFrame:
    again = t.v_colophon.select("doc_id", B.repeated_line(F.col("text")).alias("title"))
    return again.select("doc_id", F.coalesce("title", F.lit("")).alias("title"))


@query(
    "bib_15_script_share",
    oracle(
        f"""SELECT doc_id, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.0 END AS share FROM (SELECT doc_id,
        CAST(length(text) - length(translate(text, '{B.SCRIPT_TRAD}', '')) AS DOUBLE) AS a, CAST(length(text) - length(translate(text, '{B.SCRIPT_SIMP}', '')) AS DOUBLE) AS b FROM {{v_colophon}})"""
    ),
)
def _script_share(t: Tables) -> DataFrame:
    return t.v_colophon.select("doc_id", B.trad_share(F.col("text")).cast("double").alias("share"))


@query(
    "bib_17_sampled_pages",
    oracle(
        """SELECT doc_id, ord FROM pg JOIN (SELECT doc_id, bool_or(regexp_matches(t, 'ISBN|出版|定价|印刷')) AS k FROM pg WHERE ord < 16 OR n - ord <= 16 GROUP BY 1) USING (doc_id)
        WHERE ord < 16 OR n - ord <= 16 OR (NOT k AND (n <= 40 OR ord < 60 OR n - ord <= 30))""",
        **PAGED,
    ),
)
def _sampled(t: Tables) -> DataFrame:
    return B.sampled_text_pages(t.v_colophon.select("doc_id", "text"), whole=40).select("doc_id", "ord")


RIGHTS_TEXT = """
SELECT doc_id, 0 AS source_rank, 'file' AS source, CASE doc_id % 7 WHEN 0 THEN '史记_中华书局授权影印本' WHEN 1 THEN '据商务印书馆授权重印_民国丛书' ELSE 'x' END AS text FROM {documents}
UNION ALL SELECT doc_id, 1, 'folder', CASE doc_id % 5 WHEN 0 THEN '某大学图书馆藏_授权影印' WHEN 1 THEN '丛书 第' || CAST(doc_id % 7 AS STRING) || '版' ELSE '' END FROM {documents}
UNION ALL SELECT doc_id, 9, 'colophon', text FROM {v_colophon}"""


def rights_sql() -> str:
    cols = []
    for field, p in B.RIGHTS:
        p = p.replace("(?U)", "").replace("\\s", WS).replace("\\d", "[0-9]")
        v = f"regexp_extract(t, '{p}', 1)"
        if field == "isbn":
            v = f"CASE WHEN length({v}) >= 10 THEN upper({v}) END"
        elif field == "pub_date":
            m = f"regexp_extract(t, '{p}', 2)"
            v = f"CASE WHEN {v} <> '' THEN {v} || '年' || CASE WHEN {m} <> '' THEN {m} || '月' ELSE '' END END"
        else:
            least = 1 if field in ("edition", "printing") else 2
            v = f"CASE WHEN length(trim({v}, ' :：')) >= {least} THEN trim({v}, ' :：') END"
        cols.append(f'{v} AS "{field}"')
    return f"SELECT doc_id, source_rank, source, {', '.join(cols)} FROM (SELECT doc_id, source_rank, source, {half('text')} AS t FROM rt)"


@query(
    "bib_18_rights",
    oracle(
        "SELECT doc_id, "
        + ", ".join(
            f'arg_min("{f}", source_rank) FILTER (WHERE "{f}" IS NOT NULL) AS "{f}", arg_min(source, source_rank) FILTER (WHERE "{f}" IS NOT NULL) AS {f}_src'
            for f, _ in B.RIGHTS
        )
        + " FROM rc GROUP BY doc_id",
        rt=RIGHTS_TEXT,
        rc=rights_sql(),
    ),
)
def _rights(t: Tables) -> DataFrame:
    return B.rights(t.sql(RIGHTS_TEXT), ["doc_id"])


def records(t: Tables) -> DataFrame:
    return N.parse_names(t.v_catalog.select("dir", "name"), SURNAMES).withColumn("path", X.join_path(F.col("dir"), F.col("name")))


WORK = "coalesce(nullif(title, ''), name)"
VERSION = f"(CASE WHEN tail <> '' THEN 1 ELSE 0 END), (CASE ext WHEN '.pdf' THEN 0 WHEN '.txt' THEN 1 ELSE 2 END), dir || '/' || name"


@query(
    "bib_19_edition_groups",
    oracle(
        f"""SELECT work, volume, CAST(count(*) AS BIGINT) AS versions, max(first_path) AS first_path FROM (
        SELECT {WORK} AS work, volume, first_value(dir || '/' || name) OVER (PARTITION BY {WORK}, volume ORDER BY {VERSION}) AS first_path FROM pa) GROUP BY 1, 2""",
        **NAMES,
        pa=PARSED,
    ),
)
def _edition_groups(t: Tables) -> DataFrame:
    return E.edition_groups(records(t))


@query(
    "bib_20_version_order",
    oracle(
        f"SELECT {WORK} AS work, volume, dir || '/' || name AS path, CAST(row_number() OVER (PARTITION BY {WORK}, volume ORDER BY {VERSION}) AS BIGINT) AS version_no FROM pa",
        **NAMES,
        pa=PARSED,
    ),
)
def _version_order(t: Tables) -> DataFrame:
    return E.version_order(records(t).select("title", "volume", "tail", "ext", "path", "name")).select("work", "volume", "path", "version_no")


CITED = f"""
SELECT *, author || '：《' || title || '》' || CASE WHEN volume <> '' AND contains(title, trim(volume, '（）()')) THEN '' ELSE volume END
  || CASE WHEN publisher <> '' OR city <> '' OR year <> '' THEN '，' || trim(replace(replace(replace(city || '：' || publisher || '，' || year || '年', '：，', '：'), '：年', ''), '，年', '年'), '，') ELSE '' END
  || '，第' || CAST(doc_id % 300 AS VARCHAR) || '页。' AS s FROM (SELECT pa.*, coalesce(di.city, '') AS city FROM pa LEFT JOIN di USING (publisher))"""


@query(
    "bib_21_citations",
    oracle(
        "SELECT dir, name, replace(regexp_replace(replace(replace(replace(s, '， ，', '，'), '，：', '：'), '，年', ''), '，+', '，', 'g'), '，。', '。') AS citation FROM ci",
        **NAMES,
        pa=PARSED,
        di=PUBS["di"],
        ci=CITED,
    ),
)
def _citations(t: Tables) -> DataFrame:
    r = N.parse_names(t.v_catalog.select("doc_id", "dir", "name"), SURNAMES)
    cities = t.v_publishers.groupBy("publisher").agg(F.min_by("city", "pos").alias("city"))
    r = r.join(cities, "publisher", "left")
    c = F.col
    page = (c("doc_id") % 300).cast("string")
    return r.select("dir", "name", B.citation(c("title"), c("volume"), c("author"), c("publisher"), c("city"), c("year"), page).alias("citation"))


COUNTED = "SELECT dir, name, doc_id % 3 AS count FROM {v_catalog}"


@query(
    "bib_22_redundant_texts",
    oracle(
        f"""
SELECT a.dir, a.name, bool_or(b.dir IS NOT NULL AND a.ext IN ('.txt', '.text') AND a.c = b.c AND NOT a.cv) AS hidden,
  bool_or(b.dir IS NOT NULL AND a.ext IN ('.txt', '.text')) AND NOT bool_or(b.dir IS NOT NULL AND a.ext IN ('.txt', '.text') AND a.c = b.c AND NOT a.cv) AS marked
FROM k a LEFT JOIN k b ON lower(a.dir) = lower(b.dir) AND a.sk = b.sk AND b.ext = '.pdf' GROUP BY a.dir, a.name""",
        **NAMES,
        k=f"SELECT dir, name, ext, sk, doc_id % 3 AS c, regexp_matches(name, '{CONVERTED}') AS cv FROM ky",
    ),
)
def _redundant(t: Tables) -> DataFrame:
    return E.redundant_texts(t.sql(COUNTED)).select("dir", "name", "hidden", "marked")


SIBLINGS = dict(
    k=f"SELECT dir, name, ext, fk, {sub('fk', ID, chr(92) + '1' + chr(92) + '2')} AS lk, CASE WHEN regexp_matches(name, '[繁简]转[繁简]') THEN 1 ELSE 0 END AS cv FROM ky",
    c="SELECT * FROM k WHERE ext = '.txt' AND fk <> ''",
    b="SELECT dir, fk, min(CAST(cv AS VARCHAR) || name) AS b FROM c GROUP BY 1, 2",
    lo="SELECT dir, lk, min(CAST(cv AS VARCHAR) || name) AS l FROM c WHERE lk <> '' GROUP BY 1, 2 HAVING count(*) <= 6",
)


@query(
    "bib_23_24_sibling_texts",
    oracle(
        """
SELECT k.dir, k.name, CASE WHEN c.name IS NOT NULL AND CAST(c.cv AS VARCHAR) <= substr(b.b, 1, 1) THEN k.name ELSE coalesce(substr(b.b, 2), substr(lo.l, 2)) END AS peer,
  CASE WHEN b.b IS NOT NULL THEN 'family' WHEN lo.l IS NOT NULL THEN 'loose' END AS how
FROM k LEFT JOIN b ON b.dir = k.dir AND b.fk = k.fk LEFT JOIN c ON c.dir = k.dir AND c.name = k.name LEFT JOIN lo ON lo.dir = k.dir AND lo.lk = k.lk""",
        **NAMES,
        **SIBLINGS,
    ),
)
def _siblings(t: Tables) -> DataFrame:
    files = t.v_catalog.select("dir", "name")
    return E.sibling(files, files.filter(X.ext(F.col("name")) == ".txt")).select("dir", "name", "peer", "how")


RELATED = dict(
    rk=f"""
SELECT dir || '/' || name AS path, unnest(['series', 'topic', 'same_book', 'same_author']) AS class, unnest([CASE WHEN length(se) >= 3 THEN se END, regexp_extract(dir, '([^/]*)$', 1), nullif(core, ''), nullif(author, '')]) AS k
FROM (SELECT pa.dir, pa.name, pa.author, cr.core, {series_sql('cr.core')} AS se FROM pa JOIN cr ON cr.doc_id = pa.doc_id)""",
)


@query(
    "bib_26_related_works",
    oracle(
        """SELECT path, class, CAST(count(*) AS BIGINT) AS n, md5(string_agg(related, '|' ORDER BY related)) AS digest FROM (
        SELECT a.path, a.class, b.path AS related, row_number() OVER (PARTITION BY a.path, a.class ORDER BY b.path) AS rn
        FROM rk a JOIN rk b ON a.class = b.class AND a.k = b.k AND a.path <> b.path) WHERE rn <= 50 GROUP BY 1, 2""",
        **NAMES,
        pa=PARSED,
        **RELATED,
    ),
)
def _related_works(t: Tables) -> DataFrame:
    r = E.related_works(records(t).select("name", "dir", "path", "author"))
    joined = F.array_join(F.array_sort(F.collect_list("related")), "|")
    return r.groupBy("path", "class").agg(F.count(F.lit(1)).alias("n"), F.md5(joined).alias("digest"))


@query(
    "bib_26_work_keys",
    oracle("SELECT path, class, k FROM rk WHERE k IS NOT NULL", **NAMES, pa=PARSED, **RELATED),
)
def _work_keys(t: Tables) -> DataFrame:
    return E.work_keys(records(t).select("name", "dir", "path", "author"))


@query(
    "bib_27_provenance",
    oracle(
        """
SELECT dir, name, '《' || coalesce(nullif(title, ''), regexp_replace(name, '\\.[^.]*$', '')) || '》' || volume || CASE WHEN doc_id % 40 > 0 THEN '第' || CAST(doc_id % 40 AS VARCHAR) || '页' ELSE '页码未定' END AS headline,
  concat_ws('｜', nullif(author, ''), '版本：' || CASE ext WHEN '.pdf' THEN 'PDF原本' WHEN '.txt' THEN CASE WHEN contains(name, '繁转简') THEN '繁转简TXT' WHEN doc_id % 2 = 0 THEN '繁体TXT' ELSE 'TXT文本' END ELSE upper(substr(ext, 2)) END,
    nullif(publisher || CASE WHEN year <> '' THEN '·' || year || '年' ELSE '' END, ''), '文件：' || name) AS detail FROM pa""",
        **NAMES,
        pa=PARSED,
    ),
)
def _provenance(t: Tables) -> DataFrame:
    r = N.parse_names(t.v_catalog.select("doc_id", "dir", "name"), SURNAMES)
    c = F.col
    line = B.provenance(
        c("title"), c("volume"), c("author"), c("publisher"), c("year"), c("doc_id") % 2 == 0,
        (c("doc_id") % 40).cast("string"), X.join_path(c("dir"), c("name")),
    )
    return r.select("dir", "name", *line)


def text_fields(t: Tables, *exts: str) -> DataFrame:
    """Colophon fields of the catalog's own files of some formats."""
    files = t.v_catalog.filter(X.ext(F.col("name")).isin(*exts)).select("doc_id", "dir", "name")
    texts = t.v_colophon.select("doc_id", "text").join(files, "doc_id", "left_semi")
    return B.colophon_fields(texts, t.v_publishers, SURNAMES).join(files, "doc_id")


REPEATED = f"""SELECT doc_id, arg_max(l, n * 1000000 - i) AS title FROM (SELECT doc_id, l, count(*) AS n, min(i) AS i FROM (
  SELECT doc_id, {strip('l')} AS l, i FROM ln) WHERE {OK} GROUP BY doc_id, l HAVING count(*) >= 3) GROUP BY doc_id"""


def chosen_sql(tag: str, exts: str) -> dict[str, str]:
    """CTEs choosing for each file the telling text of one format."""
    return {
        f"{tag}_t": f"SELECT * FROM k WHERE ext IN ({exts}) AND fk <> '' AND doc_id IN (SELECT doc_id FROM tf WHERE coalesce(title, author, publisher, city, year) IS NOT NULL)",
        f"{tag}_b": f"SELECT dir, fk, min(CAST(cv AS VARCHAR) || name) AS b FROM {tag}_t GROUP BY 1, 2",
        f"{tag}_l": f"SELECT dir, lk, min(CAST(cv AS VARCHAR) || name) AS l FROM {tag}_t WHERE lk <> '' GROUP BY 1, 2 HAVING (dir, lk) IN (SELECT (dir, lk) FROM k WHERE ext IN ({exts}) AND fk <> '' GROUP BY dir, lk HAVING count(*) <= 6)",
        f"{tag}_p": f"""SELECT k.doc_id AS id, CASE WHEN o.name IS NOT NULL AND CAST(o.cv AS VARCHAR) <= substr(b.b, 1, 1) THEN k.name ELSE coalesce(substr(b.b, 2), substr(l.l, 2)) END AS file
FROM k LEFT JOIN {tag}_b b ON b.dir = k.dir AND b.fk = k.fk LEFT JOIN {tag}_t o ON o.doc_id = k.doc_id LEFT JOIN {tag}_l l ON l.dir = k.dir AND l.lk = k.lk""",
        tag: f"SELECT {tag}_p.id, {tag}_p.file, tf.* EXCLUDE (doc_id) FROM {tag}_p JOIN k ON k.doc_id = {tag}_p.id LEFT JOIN k f ON f.dir = k.dir AND f.name = {tag}_p.file LEFT JOIN tf ON tf.doc_id = f.doc_id",
    }


def merged_sql() -> str:
    cols = []
    for field in ("title", "volume", "author", "publisher", "year", "ssid", "city"):
        own = [("file", f"nullif(pa.{field}, '')")] if field != "city" else []
        more = [(x, f"{x}.{field}") for x in ("txt", "pdf")] if field not in ("volume", "ssid") else []
        values = own + more
        cols.append(f"coalesce({', '.join(v for _, v in values)}, NULL) AS {field}")
        cols.append("CASE " + " ".join(f"WHEN {v} IS NOT NULL THEN '{x}'" for x, v in values) + f" END AS {field}_src")
    return "SELECT pa.doc_id, pa.dir, pa.name, txt.file AS txt_file, coalesce(txt.block, pdf.block) AS block, " + ", ".join(cols) + " FROM pa LEFT JOIN txt ON txt.id = pa.doc_id LEFT JOIN pdf ON pdf.id = pa.doc_id"


def count_sql(chars: str) -> str:
    return f"(length(block) - length(translate(block, '{chars}', '')))"


DEEP_COLUMNS = ["dir", "name", "txt_file"] + [c for f in B.FIELDS[:-1] for c in (f, f"{f}_src")]


@query(
    "bib_16_deep_records",
    oracle(
        f"""SELECT {', '.join('mr.' + c for c in DEEP_COLUMNS)}, coalesce(mr.city, di.city) AS city, CASE WHEN mr.city IS NULL AND di.city IS NOT NULL THEN 'dict' ELSE city_src END AS city_src,
        coalesce({count_sql(B.SCRIPT_TRAD)} > 0 AND {count_sql(B.SCRIPT_TRAD)} >= {count_sql(B.SCRIPT_SIMP)}, false) AS trad FROM mr LEFT JOIN di ON di.publisher = mr.publisher""",
        **LINES,
        cp0=CIPS,
        cp=CIPS2,
        **PUBS,
        **PARTIES,
        **TITLES,
        rp=REPEATED,
        yy=f"SELECT doc_id, {year_sql('block', 'year')} FROM cp",
        tf="""SELECT bl.doc_id, bl.block, coalesce(nullif(cp.title, ''), nullif(tt.title, ''), rp.title) AS title, coalesce(nullif(cp.author, ''), nullif(au.authors, '')) AS author,
  coalesce(nullif(cp.publisher, ''), nullif(pb.publisher, '')) AS publisher, coalesce(nullif(cp.city, ''), nullif(pb.city, '')) AS city, coalesce(nullif(cp.year, ''), nullif(yy.year, '')) AS year
FROM bl JOIN cp USING (doc_id) JOIN pb USING (doc_id) JOIN tt USING (doc_id) JOIN au USING (doc_id) JOIN yy USING (doc_id) LEFT JOIN rp USING (doc_id)""",
        **NAMES,
        pa=PARSED,
        k=SIBLINGS["k"].replace("SELECT dir", "SELECT doc_id, dir"),
        **chosen_sql("txt", "'.txt', '.text'"),
        **chosen_sql("pdf", "'.pdf'"),
        mr=merged_sql(),
    ),
)
def _deep(t: Tables) -> DataFrame:
    d = B.deep_records(t.v_catalog, text_fields(t, ".txt", ".pdf"), None, t.v_publishers, SURNAMES)
    return d.select(*DEEP_COLUMNS, "city", "city_src", "trad")
