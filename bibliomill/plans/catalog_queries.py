"""Catalog, target and relocation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliomill.functions.variants import Variants
from bibliomill.operators import catalog as C
from bibliomill.operators import paging as P
from bibliomill.operators import relocate as R
from bibliomill.operators import search as S
import bibliomill.plans.inputs  # noqa: F401  the derived inputs
from bibliomill.plans.registry import Tables, oracle, query
from bibliomill.plans.search_queries import PAGES_SQL, hits1, hits_oracle

EXT = "lower(regexp_extract(name, '^\\.*[^.].*(\\.[^.]*)$', 1))"
STEM = "substr(name, 1, length(name) - length(regexp_extract(name, '^\\.*[^.].*(\\.[^.]*)$', 1)))"

LISTING = """
SELECT page_id, 'www' AS root,
  'www/' || path || CASE page_id % 6 WHEN 0 THEN '/.git/x.pdf' WHEN 1 THEN '/Node_Modules/y.txt' WHEN 2 THEN '.PDF'
     WHEN 3 THEN '.bin' WHEN 4 THEN '/a.b.tar' ELSE '/页.epub' END AS path,
  CAST(size AS BIGINT) AS size
FROM {v_urls}"""


@query(
    "src_01_kept_files",
    oracle(
        f"""
SELECT path, dir, name, {STEM} AS stem, ext, size FROM (
  SELECT *, {EXT} AS ext FROM (
    SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM l))
WHERE ext IN ({", ".join("'" + e + "'" for e in C.EXTS)})
  AND NOT list_bool_or(list_transform(string_split(dir, '/'), lambda d: lower(d) IN ({", ".join("'" + d + "'" for d in C.SKIP_DIRS)}) OR starts_with(d, '.')))""",
        l=LISTING,
    ),
)
def _kept_files(t: Tables) -> DataFrame:
    return C.kept_files(t.sql(LISTING)).select("path", "dir", "name", "stem", "ext", "size")


FOREIGN = "SELECT url AS FilePath, regexp_replace(path, '^.*/', '') AS Title, size AS Size FROM {v_urls}"


@query(
    "src_07_foreign_catalog",
    oracle(
        """SELECT Title AS name, regexp_extract(FilePath, '^(.*)/[^/]*$', 1) AS dir, CAST(Size AS BIGINT) AS size, CAST(0 AS DOUBLE) AS mtime,
           FilePath AS path FROM f""",
        f=FOREIGN,
    ),
)
def _foreign(t: Tables) -> DataFrame:
    from bibliomill.sources.foreign import adapt_foreign

    return adapt_foreign({"documents": t.sql(FOREIGN), "other": t.nation}).select("name", "dir", "size", "mtime", "path")


DIFF = """
SELECT coalesce(o.dir, n.dir) AS dir, coalesce(o.name, n.name) AS name,
  CASE WHEN o.name IS NULL THEN 'add'
       WHEN n.name IS NULL THEN CASE WHEN o.root IN (SELECT root FROM {v_new}) THEN 'delete' ELSE 'held' END
       WHEN o.size = n.size AND abs(o.mtime - n.mtime) < 1 THEN 'same' ELSE 'update' END AS action,
  o.size AS osize, n.size AS nsize
FROM {v_old} o FULL JOIN {v_new} n ON o.dir = n.dir AND o.name = n.name"""


@query(
    "cat_01_snapshot_diff",
    oracle(
        "SELECT dir, name, action, CASE WHEN action IN ('add', 'update') THEN nsize ELSE osize END AS size FROM d", d=DIFF
    ),
)
def _diff(t: Tables) -> DataFrame:
    return C.snapshot_diff(t.v_old, t.v_new).select("dir", "name", "action", "size")


@query(
    "cat_01_diff_counts", oracle("SELECT action, CAST(count(*) AS BIGINT) AS files FROM d GROUP BY action", d=DIFF)
)
def _diff_counts(t: Tables) -> DataFrame:
    return C.diff_counts(C.snapshot_diff(t.v_old, t.v_new))


KEYWORDS = "SELECT * FROM (VALUES ('book-1'), ('近代 史料'), ('OCR.txt'), ('shelf3'), ('%'), ('absent')) AS k(kw)"
MANY_KEYWORDS = "SELECT DISTINCT 'BOOK, ' || CAST(floor(doc_id / 8) AS BIGINT) AS kw FROM {documents}"
NORM = "regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def name_search_sql(keywords: str, limit: int | None = None) -> str:
    return oracle(
        f"""
SELECT kw, dir, name, matched FROM (SELECT *, row_number() OVER (PARTITION BY kw ORDER BY dir, name) AS rn FROM (
  SELECT kw, dir, name, 'phrase' AS matched FROM ph
  UNION ALL
  SELECT kw, dir, name, 'plain' FROM k JOIN {{v_catalog}} c ON contains(lower(c.name), lower(kw)) OR contains(lower(c.dir), lower(kw))
  WHERE kw NOT IN (SELECT kw FROM ph))) {"" if limit is None else f"WHERE rn <= {limit}"}""",
        k=keywords,
        ph=f"""SELECT kw, dir, name FROM k JOIN {{v_catalog}} c
  ON {NORM.format(c="kw")} <> '' AND contains({NORM.format(c="c.name")}, {NORM.format(c="kw")})""",
    )


@query("cat_02_name_search", name_search_sql(KEYWORDS))
def _name_search(t: Tables) -> DataFrame:
    return C.name_search(t.v_catalog, t.sql(KEYWORDS))


@query("cat_02_name_search_top", name_search_sql(MANY_KEYWORDS, 50))
def _name_search_many(t: Tables) -> DataFrame:
    return C.name_search(t.v_catalog, t.sql(MANY_KEYWORDS), limit=50, constant_limit=16).drop("rank")


ASKED_DIRS = "SELECT DISTINCT upper(dir) AS dir FROM {v_catalog} WHERE root <> 'lib1'"


@query(
    "cat_03_files_in_dirs",
    oracle(
        "SELECT dir, name FROM {v_catalog} WHERE lower(dir) IN (SELECT lower(dir) FROM a)",
        a=ASKED_DIRS,
    ),
)
def _in_dirs(t: Tables) -> DataFrame:
    return C.files_in_dirs(t.v_catalog, t.sql(ASKED_DIRS)).select("dir", "name")


@query(
    "cat_03_files_in_dirs_top",
    oracle(
        """SELECT dir, name, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lower(dir) ORDER BY name, dir) AS rn
           FROM {v_catalog} WHERE lower(dir) IN (SELECT lower(dir) FROM a)) WHERE rn <= 7""",
        a=ASKED_DIRS,
    ),
)
def _in_dirs_top(t: Tables) -> DataFrame:
    found = C.files_in_dirs(t.v_catalog, t.sql(ASKED_DIRS), limit=7)
    return found.select("dir", "name", F.col("rank").cast("long").alias("rank"))


@query(
    "cat_04_files_in_dirs_by_ext",
    oracle(
        f"""SELECT dir, name FROM (SELECT *, row_number() OVER (PARTITION BY lower(dir) ORDER BY name, dir) AS rn
           FROM {{v_catalog}} WHERE lower(dir) IN (SELECT lower(dir) FROM a) AND {EXT} IN ('.txt', '.epub')) WHERE rn <= 5""",
        a=ASKED_DIRS,
    ),
)
def _in_dirs_ext(t: Tables) -> DataFrame:
    return C.files_in_dirs(t.v_catalog, t.sql(ASKED_DIRS), [".TXT", ".epub"], 5).select("dir", "name")


@query(
    "cat_05_dir_counts",
    oracle(f"SELECT dir, CAST(count(*) AS BIGINT) AS files FROM {{v_catalog}} WHERE {EXT} IN ('.pdf', '.txt') GROUP BY dir"),
)
def _dir_counts(t: Tables) -> DataFrame:
    return C.dir_counts(t.v_catalog, [".pdf", ".txt"])


@query(
    "cat_06_stem_prefix",
    oracle(f"SELECT dir, name FROM {{v_catalog}} WHERE starts_with(lower({STEM}), 'book 1')"),
)
def _stem_prefix(t: Tables) -> DataFrame:
    return C.stem_prefix(t.v_catalog, "Book 1").select("dir", "name")


@query(
    "cat_06_stem_prefix_top",
    oracle(f"SELECT dir, name FROM {{v_catalog}} WHERE starts_with(lower({STEM}), 'book 1') ORDER BY name, dir LIMIT 30"),
)
def _stem_prefix_top(t: Tables) -> DataFrame:
    return C.stem_prefix(t.v_catalog, "Book 1", 30).select("dir", "name")


@query(
    "cat_07_stats",
    oracle(
        """SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes,
           CAST(count(*) FILTER (WHERE (dir, name) NOT IN (SELECT (dir, name) FROM {v_new})) AS BIGINT) AS missing FROM {v_old}"""
    ),
)
def _stats(t: Tables) -> DataFrame:
    return C.catalog_stats(t.v_old, t.v_new)


@query("cat_08_filter_ext", oracle(f"SELECT dir, name FROM {{v_catalog}} WHERE {EXT} NOT IN ('.pdf', '.epub')"))
def _filter_ext(t: Tables) -> DataFrame:
    return C.filter_ext(t.v_catalog, ["PDF", ".epub"]).select("dir", "name")


@query(
    "cat_09_summary",
    oracle(
        f"""SELECT CASE WHEN grouping(ext) = 1 THEN '*' ELSE ext END AS ext, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes
        FROM (SELECT *, {EXT} AS ext FROM {{v_catalog}}) GROUP BY ROLLUP (ext)"""
    ),
)
def _summary(t: Tables) -> DataFrame:
    return C.summarize(t.v_catalog)


@query(
    "cat_10_books",
    oracle(
        """SELECT dir, regexp_extract(dir, '([^/]*)$', 1) AS title, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes,
           min(name) AS first_file FROM {v_catalog} GROUP BY dir HAVING count(*) >= 2"""
    ),
)
def _books(t: Tables) -> DataFrame:
    return C.group_by_book(t.v_catalog, 2)


@query(
    "cat_10_book_files",
    oracle("SELECT dir, name, CAST(row_number() OVER (PARTITION BY dir ORDER BY name) AS BIGINT) AS file_no FROM {v_catalog}"),
)
def _book_files(t: Tables) -> DataFrame:
    return C.book_files(t.v_catalog).select("dir", "name", "file_no")


SOURCES = """
SELECT target, src, i FROM (
  SELECT target, l, unnest(l) AS src, generate_subscripts(l, 1) AS i FROM (
    SELECT target, list_filter(list_transform(string_split(location, ';'), lambda p: rtrim(trim(p), '/\\')), lambda p: p <> '') AS l FROM {v_targets}))"""
MATCHED = """
SELECT target, src, i, min_by(key, prio * 1000 + pos) AS key, min_by(expected, prio * 1000 + pos) AS expected,
  min_by(main, prio * 1000 + pos) AS main, min_by(level, prio * 1000 + pos) AS level
FROM (SELECT s.*, w.*, CASE WHEN lower(src) = lower(expected) THEN 0 ELSE 1 END AS prio FROM s JOIN {v_watch} w
  ON lower(src) = lower(expected) OR regexp_extract(lower(src), '([^/]*)$', 1) = regexp_extract(lower(expected), '([^/]*)$', 1))
GROUP BY target, src, i"""
HERE = "SELECT DISTINCT lower(dir) AS d FROM {v_present}"
STATUS = dict(s=SOURCES, m=MATCHED, here=HERE)


@query(
    "cat_12_target_status",
    oracle(
        """
SELECT target, CAST(sources AS BIGINT) AS sources, CAST(missing AS BIGINT) AS missing, CAST(main AS BIGINT) AS main,
  CAST(main_missing AS BIGINT) AS main_missing, state, state NOT IN ('unknown', 'missing') AS may_update,
  state NOT IN ('unknown', 'missing') AND missing > 0 AS at_risk
FROM (SELECT *, CASE WHEN sources = 0 THEN 'unknown'
    WHEN main > 0 THEN CASE WHEN main_missing = 0 THEN 'ok' WHEN main_missing < main THEN 'partial' ELSE 'missing' END
    WHEN missing < sources THEN 'ok' ELSE 'missing' END AS state
  FROM (SELECT t.target, count(s.src) AS sources, count(s.src) FILTER (WHERE lower(s.src) NOT IN (SELECT d FROM here)) AS missing,
      count(*) FILTER (WHERE m.main) AS main, count(*) FILTER (WHERE m.main AND lower(m.expected) NOT IN (SELECT d FROM here)) AS main_missing
    FROM {v_targets} t LEFT JOIN s USING (target) LEFT JOIN m ON m.target = s.target AND m.i = s.i GROUP BY t.target))""",
        **STATUS,
    ),
)
def _status(t: Tables) -> DataFrame:
    return C.dir_status(t.v_targets, t.v_watch, t.v_present)


LOCATED = """
SELECT w.*, CASE WHEN lower(expected) IN (SELECT d FROM here) THEN expected
  ELSE (SELECT min(dir) FROM {v_present} p WHERE regexp_extract(lower(p.dir), '([^/]*)$', 1) = regexp_extract(lower(w.expected), '([^/]*)$', 1)) END AS actual,
  lower(expected) NOT IN (SELECT d FROM here) AS away
FROM {v_watch} w"""


@query(
    "cat_13_watch_check",
    oracle(
        """SELECT key, expected, actual, actual IS NOT NULL AS found, away AND actual IS NOT NULL AS translated, level, main
        FROM loc WHERE actual IS NOT NULL OR level <> 'dual' OR key IN (SELECT key FROM m)""",
        **STATUS,
        loc=LOCATED,
    ),
)
def _watch_check(t: Tables) -> DataFrame:
    return C.check_watch(t.v_watch, t.v_targets, t.v_present)


@query(
    "cat_13_learned_watch",
    oracle(
        """SELECT regexp_extract(expected, '([^/]*)$', 1) AS key, expected FROM (
        SELECT arg_min(src, [target, lpad(CAST(i AS VARCHAR), 4, '0')]) AS expected FROM s GROUP BY lower(src))""",
        s=SOURCES,
    ),
)
def _learned(t: Tables) -> DataFrame:
    return C.learned_watch(t.v_targets).select("key", "expected")


@query(
    "cat_13_hidden_targets",
    oracle(
        """SELECT target FROM {v_targets} t WHERE NOT store_exists
        AND (SELECT arg_min(level, i) FROM m WHERE m.target = t.target) = 'dual'
        AND target NOT IN (SELECT target FROM s WHERE lower(src) IN (SELECT d FROM here))""",
        **STATUS,
    ),
)
def _hidden(t: Tables) -> DataFrame:
    return C.hidden_targets(t.v_targets, t.v_watch, t.v_present).select("target")


@query(
    "cat_14_describe_targets",
    oracle(
        """SELECT t.target, coalesce(string_agg(k.key, ',' ORDER BY k.i), '') AS books, t.s_suppkey % 4 = 0 AS registered
        FROM {v_targets} t LEFT JOIN (SELECT target, key, min(i) AS i FROM m GROUP BY 1, 2) k USING (target) GROUP BY t.target, t.s_suppkey""",
        **STATUS,
    ),
)
def _describe(t: Tables) -> DataFrame:
    known = t.v_targets.filter("s_suppkey % 4 = 0")
    d = C.describe_targets(t.v_targets, t.v_watch, known)
    return d.withColumn("books", F.array_join("books", ","))


@query(
    "cat_14_target_stats",
    oracle(
        "SELECT root, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes, max(mtime) AS last_change FROM {v_catalog} GROUP BY root"
    ),
)
def _target_stats(t: Tables) -> DataFrame:
    return C.target_stats(t.v_catalog)


@query(
    "txt_18_resolve_targets",
    oracle(
        """SELECT target, CAST(min(pos) AS BIGINT) AS pos FROM (
        SELECT a.pos, coalesce(g.member, a.name) AS target FROM {v_asked} a LEFT JOIN {v_groups} g USING (name)) GROUP BY target"""
    ),
)
def _resolve(t: Tables) -> DataFrame:
    groups = t.v_groups.withColumnRenamed("name", "group")
    return C.resolve_targets(t.v_asked, groups).select("target", "pos")


@query(
    "txt_18_unknown_members",
    oracle('SELECT name AS "group", member FROM {v_groups} WHERE member NOT IN (SELECT target FROM {v_targets})'),
)
def _unknown(t: Tables) -> DataFrame:
    return C.unknown_members(t.v_groups.withColumnRenamed("name", "group"), t.v_targets).select("group", "member")


PATH_GROUPS = """
SELECT 'group ' || CAST(s_nationkey AS STRING) AS name,
  'STORE/' || CAST(s_suppkey + CASE WHEN s_nationkey % 5 = 0 THEN 1000000 ELSE 0 END AS STRING) || '/' AS member, s_suppkey AS member_pos
FROM {supplier}"""


@query(
    "txt_18_path_groups",
    oracle(
        """SELECT DISTINCT name AS "group", CASE WHEN bool_and(t.target IS NOT NULL) OVER (PARTITION BY name) THEN t.target ELSE name END AS target
        FROM pg LEFT JOIN {v_targets} t ON lower(rtrim(pg.member, '/')) = lower(t.store)""",
        pg=PATH_GROUPS,
    ),
)
def _path_groups(t: Tables) -> DataFrame:
    groups = t.sql(PATH_GROUPS).withColumnRenamed("name", "group")
    return C.path_group_targets(groups, t.v_targets).select("group", "target")


@query(
    "txt_22_book_report",
    hits_oracle(
        f"""SELECT dir, regexp_extract(dir, '([^/]*)$', 1) AS title, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes,
        arg_min(name, CASE WHEN {EXT} = '.pdf' THEN '0' ELSE '1' END || name) AS open_file
        FROM {{v_catalog}} WHERE doc_id IN (SELECT doc_id FROM h1) AND {EXT} IN ('.pdf', '.txt') GROUP BY dir
        ORDER BY files DESC, title, dir LIMIT 20"""
    ),
)
def _report(t: Tables) -> DataFrame:
    found = hits1(t).select("doc_id").distinct()
    files = C.filter_ext(t.v_catalog.join(found, "doc_id", "left_semi"), ["pdf", "txt"], exclude=False)
    return C.top_books(files)


@query(
    "txt_22_ext_distribution",
    hits_oracle(
        f"""SELECT ext, CAST(count(*) AS BIGINT) AS files FROM (SELECT {EXT} AS ext FROM {{v_catalog}} WHERE doc_id IN (SELECT doc_id FROM h1))
        GROUP BY ext ORDER BY files DESC, ext LIMIT 6"""
    ),
)
def _ext_distribution(t: Tables) -> DataFrame:
    found = hits1(t).select("doc_id").distinct()
    return C.ext_distribution(t.v_catalog.join(found, "doc_id", "left_semi"))


BASES = f"""
SELECT dir, name, {EXT} AS ext, regexp_replace({STEM}, '_?【(繁转简|简转繁)】$', '') AS base,
  regexp_extract({STEM}, '_?【(?:繁转简|简转繁)】$') AS ending FROM {{v_catalog}}"""


@query(
    "txt_23_originals",
    oracle(
        """SELECT b.dir, b.name, b.base, p.pdf, p.txt, coalesce(p.pdf, b.name) AS open_file, CASE ending WHEN '_【简转繁】' THEN 't2s' ELSE 's2t' END AS terms_to
        FROM b LEFT JOIN (SELECT dir, base, min(name) FILTER (WHERE ext = '.pdf') AS pdf, min(name) FILTER (WHERE ext = '.txt') AS txt
          FROM b WHERE ending = '' GROUP BY 1, 2) p USING (dir, base) WHERE b.ending <> '' AND b.ext = '.txt'""",
        b=BASES,
    ),
)
def _originals(t: Tables) -> DataFrame:
    return C.originals(t.v_catalog)


# A dictionary with phrases; the longest that fits goes first.
PHRASES = [("t2s", "the", "que"), ("t2s", "th", "zz"), ("s2t", "der", "the"), ("s2t", "d", "x")]
ASKED = ["the", "der", "and", "with"]
CONVERTED = """SELECT * FROM (VALUES ('t2s', 'the', 'que'), ('t2s', 'der', 'der'), ('t2s', 'and', 'and'), ('t2s', 'with', 'wizz'),
  ('s2t', 'the', 'the'), ('s2t', 'der', 'the'), ('s2t', 'and', 'anx'), ('s2t', 'with', 'with')) AS w(terms_to, asked, term)"""


@query(
    "txt_23_converted_hits",
    oracle(
        """SELECT o.dir, o.open_file AS name, o.terms_to, w.asked, w.term, CAST(p.page AS BIGINT) AS page,
          CAST((length(p.t) - length(replace(p.t, w.term, ''))) / length(w.term) AS BIGINT) AS count
        FROM (SELECT DISTINCT b.dir, coalesce(f.pdf, b.name) AS open_file, CASE ending WHEN '_【简转繁】' THEN 't2s' ELSE 's2t' END AS terms_to
          FROM b LEFT JOIN (SELECT dir, base, min(name) FILTER (WHERE ext = '.pdf') AS pdf FROM b WHERE ending = '' GROUP BY 1, 2) f USING (dir, base)
          WHERE b.ending <> '' AND b.ext = '.txt') o
        JOIN {v_catalog} c ON c.dir = o.dir AND c.name = o.open_file
        JOIN p ON p.doc_id = c.doc_id JOIN w ON w.terms_to = o.terms_to AND contains(p.t, w.term)""",
        b=BASES,
        p=PAGES_SQL,
        w=CONVERTED,
    ),
)
def _converted_hits(t: Tables) -> DataFrame:
    files = t.v_catalog.select("doc_id", "dir", "name")
    pages = P.text_pages(t.documents.select("doc_id", "lang", "source", "text")).join(files, "doc_id").select("dir", "name", "ord", "page", "text")
    terms = t.spark.createDataFrame([(w, i) for i, w in enumerate(ASKED)], "term string, pos int")
    phrases = Variants.of(t.spark.createDataFrame(PHRASES, "config string, src string, dst string"))
    hits = S.converted_hits(pages, C.originals(t.v_catalog), terms, phrases)
    return hits.select("dir", "name", "terms_to", "asked", "term", F.col("page").cast("long").alias("page"), "count")


FEW_RULES = """
SELECT * FROM (VALUES
  ('a', 'blog', 'X:/flat', true), ('b', 'm.', 'never', true),
  ('c', 'BLOG.ththan.example.net/', 'Y:/ththan/', true), ('d', 'blog.ththan.example.net/en', 'Z:/en', true),
  ('e', 'ththth.example.net', 'ththth.example.net', true), ('f', 'therin.example.net', 'Q:/x', false)
) AS r(key, expected, actual, translated)"""
MANY_RULES = """
SELECT DISTINCT 'host ' || h AS key, upper(h) AS expected, 'N:/' || h AS actual, length(h) % 5 <> 0 AS translated
FROM (SELECT regexp_replace(path, '/.*$', '') AS h FROM {v_urls})
UNION ALL
SELECT DISTINCT 'lang ' || h AS key, h || '/' AS expected, 'L:/' || h || '/' AS actual, true AS translated
FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS h FROM {v_urls} WHERE page_id % 2 = 0)
UNION ALL
SELECT DISTINCT 'trap ' || h AS key, substr(h, 1, length(h) - 1) AS expected, 'T:/' AS actual, true AS translated
FROM (SELECT regexp_replace(path, '/.*$', '') AS h FROM {v_urls})"""


def relocated_sql(rules: str) -> str:
    return oracle(
        """
SELECT page_id, path, coalesce(arg_max(actual || substr(path, length(expected) + 1), [length(expected), 0]), path) AS new_path,
  arg_max(key, [length(expected), 0]) AS rule
FROM {v_urls} u LEFT JOIN (SELECT * FROM ru WHERE translated AND rtrim(lower(expected), '/') <> rtrim(lower(actual), '/')) r
  ON starts_with(lower(u.path) || '/', rtrim(lower(r.expected), '/') || '/')
GROUP BY page_id, path""",
        ru=rules,
    )


@query("join_05_relocated_few_rules", relocated_sql(FEW_RULES))
def _relocated_few(t: Tables) -> DataFrame:
    return R.relocated(t.v_urls, t.sql(FEW_RULES)).select("page_id", "path", "new_path", "rule")


@query("join_05_relocated_many_rules", relocated_sql(MANY_RULES))
def _relocated_many(t: Tables) -> DataFrame:
    return R.relocated(t.v_urls, t.sql(MANY_RULES), limit=8).select("page_id", "path", "new_path", "rule")


# Rules with final separators, blanks and the root; paths with blanks before them.
EDGE_RULES = """
SELECT key, expected, actual, true AS translated FROM (VALUES ('r1', 'D:/a////', 'X:/one'), ('r2', 'D:/a/b', 'Y:/two'),
  ('r0', '/', 'Z:'), ('r3', ' E:/q/ ', 'W:'), ('r4', 'd:/A', 'V:/later')) AS r(key, expected, actual)"""
EDGE_PATHS = """
SELECT s_suppkey AS page_id, CASE s_suppkey % 6 WHEN 0 THEN '  D:/a/b/c' WHEN 1 THEN 'D:/a/b/c' WHEN 2 THEN '/etc/f'
  WHEN 3 THEN 'd:/A/x' WHEN 4 THEN 'D:/ab/c' ELSE 'e:/q/' END || CAST(s_suppkey AS STRING) AS path FROM {supplier}"""


@query(
    "join_05_relocated_edge_rules",
    oracle(
        """
SELECT w AS way, page_id, CASE page_id % 6 WHEN 0 THEN 'Y:/two/c' WHEN 1 THEN 'Y:/two/c' WHEN 2 THEN 'Z:/etc/f' WHEN 3 THEN 'X:/one/x'
  WHEN 4 THEN 'D:/ab/c' ELSE 'W:/' END || page_id AS new_path, CASE page_id % 6 WHEN 0 THEN 'r2' WHEN 1 THEN 'r2' WHEN 2 THEN 'r0' WHEN 3 THEN 'r1' WHEN 5 THEN 'r3' END AS rule
FROM (SELECT s_suppkey AS page_id FROM supplier), (VALUES ('carried'), ('joined')) AS w(w)"""
    ),
)
def _relocated_edges(t: Tables) -> DataFrame:
    paths, rules = t.sql(EDGE_PATHS), t.sql(EDGE_RULES)
    ways = [R.relocated(paths, rules, limit=n).select(F.lit(w).alias("way"), "page_id", "new_path", "rule") for w, n in (("carried", 512), ("joined", 1))]
    return ways[0].unionByName(ways[1])


# Records of files as they were noted, and the moves remembered since.
WANTED = """
SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'old/' || dir || '/' || name ELSE 'gone/place/' || name END AS path,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN name WHEN 2 THEN 'x' || name ELSE regexp_replace(name, '[_(（].*$', '') END AS fn,
  size + doc_id % 2 AS size, CAST(1 + doc_id % 3 AS BIGINT) AS npages FROM {v_catalog}"""
MOVES = "SELECT 'gone/place/' || name AS old_key, 'now/' || name AS new_path, doc_id AS moved_at FROM {v_catalog} WHERE doc_id % 5 = 0"
PRINTED = "SELECT dir, name, size + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS size, CAST(1 + doc_id % 3 AS BIGINT) AS npages FROM {v_catalog}"


@query(
    "join_09_find_moved",
    oracle(
        """
SELECT id, coalesce(f1, f2, f3, f4) AS found,
  CASE WHEN f1 IS NOT NULL THEN 'map' WHEN f2 IS NOT NULL THEN 'fingerprint' WHEN f3 IS NOT NULL THEN 'tail' WHEN f4 IS NOT NULL THEN 'title' ELSE 'none' END AS matched_by
FROM (SELECT id,
  coalesce((SELECT arg_max(new_path, moved_at) FROM mv WHERE old_key = w.path OR lower(old_key) = w.path),
           (SELECT arg_max(new_path, moved_at) FROM mv WHERE old_key = lower(w.path) OR lower(old_key) = lower(w.path)),
           (SELECT arg_max(new_path, moved_at) FROM mv WHERE regexp_extract(old_key, '([^/]*)$', 1) = coalesce(w.fn, regexp_extract(w.path, '([^/]*)$', 1)))) AS f1,
  (SELECT min(to_path) FROM c WHERE c.name = w.fn AND c.size = w.size AND c.npages = w.npages) AS f2,
  (SELECT min(to_path) FROM c WHERE regexp_extract(lower(to_path), '([^/]+/[^/]+)$', 1) = regexp_extract(lower(w.path), '([^/]+/[^/]+)$', 1)) AS f3,
  (SELECT min(to_path) FROM c WHERE length(ti) >= 2 AND starts_with(c.st, ti)) AS f4
FROM (SELECT *, lower(regexp_replace(f, '^(.+)\\.[^.]*$', '\\1')) AS ti FROM (SELECT *, coalesce(fn, regexp_extract(path, '([^/]*)$', 1)) AS f FROM wa)) w)""",
        wa=WANTED,
        mv=MOVES,
        c="SELECT *, dir || '/' || name AS to_path, lower(regexp_replace(name, '^(.+)\\.[^.]*$', '\\1')) AS st FROM (" + PRINTED + ")",
    ),
)
def _find_moved(t: Tables) -> DataFrame:
    return R.find_moved(t.sql(WANTED), t.sql(MOVES), t.sql(PRINTED))


@query(
    "join_10_matched_watch",
    oracle("SELECT target, src, key FROM m", **STATUS),
)
def _matched_watch(t: Tables) -> DataFrame:
    return C.match_watch(C.target_sources(t.v_targets), t.v_watch).select("target", "src", "key")


@query(
    "snk_05_relocation_map",
    oracle(
        "SELECT key, expected, coalesce(actual, '') AS actual, away AND actual IS NOT NULL AS translated FROM loc",
        here=HERE,
        loc=LOCATED,
    ),
)
def _relocation_map(t: Tables) -> DataFrame:
    return R.relocation_map(C.locate_dirs(t.v_watch, t.v_present))
