"""Date mention queries; the checks compute what must be found from the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliomill.functions import calendar as K
from bibliomill.operators import mentions as M
import bibliomill.plans.inputs  # noqa: F401  the derived inputs
from bibliomill.plans.registry import Tables, oracle, query

ERA_VALUES = "SELECT * FROM (VALUES " + ", ".join(
    f"('{e}', {a}, {b if b is not None else 'NULL'}, {str(any(c in K.TRADITIONAL_ERA_CHARS for c in e)).lower()}, {o})"
    for o, (e, a, b) in enumerate(K.ERAS)
) + ") AS e(era, a, b, trad, o)"
SPELL = """CASE WHEN {n} = 1 THEN '元' WHEN {n} < 10 THEN substr('一二三四五六七八九', {n}, 1)
 WHEN {n} < 100 THEN CASE WHEN {n} < 20 THEN '' ELSE substr('一二三四五六七八九', {n} // 10, 1) END || '十' || CASE WHEN {n} % 10 = 0 THEN '' ELSE substr('一二三四五六七八九', {n} % 10, 1) END
 ELSE substr('一二三四五六七八九', {n} // 100, 1) || '百' || CASE WHEN {n} % 100 = 0 THEN '' WHEN {n} % 100 < 10 THEN '〇' || substr('一二三四五六七八九', {n} % 10, 1)
  ELSE CASE WHEN {n} % 100 < 20 THEN '' ELSE substr('一二三四五六七八九', {n} % 100 // 10, 1) END || '十' || CASE WHEN {n} % 10 = 0 THEN '' ELSE substr('一二三四五六七八九', {n} % 10, 1) END END END"""

EXPECTED = dict(
    er=ERA_VALUES,
    yr="SELECT range AS y FROM range(1368, 2100)",
    us=f"SELECT yr.y, string_agg(er.era || {SPELL.format(n='(yr.y - er.a + 1)')} || '年', '、' ORDER BY er.a, er.o) AS used FROM yr JOIN er ON NOT er.trad AND er.a <= yr.y AND yr.y <= coalesce(er.b, er.a + 40) GROUP BY yr.y",
    cy="SELECT y, substr('甲乙丙丁戊己庚辛壬癸', CAST((y + 6) % 10 + 1 AS INT), 1) || substr('子丑寅卯辰巳午未申酉戌亥', CAST((y + 8) % 12 + 1 AS INT), 1) AS gz FROM (SELECT range AS y FROM range(1700, 2001))",
    cl="SELECT gz, string_agg(CAST(y AS VARCHAR), '、' ORDER BY y) AS l FROM cy GROUP BY gz",
    nm="""
SELECT doc_id, 0 AS pos, '民国' AS era, n, CAST(n AS VARCHAR) AS num FROM {v_date_text} WHERE doc_id % 8 = 0
UNION ALL SELECT doc_id, 0, '光绪', n, cn FROM {v_date_text} WHERE doc_id % 8 = 1
UNION ALL SELECT doc_id, 1, '康熙', n + 20, CAST(n + 20 AS VARCHAR) FROM {v_date_text} WHERE doc_id % 8 = 1
UNION ALL SELECT doc_id, 0, '明治', 1, '元' FROM {v_date_text} WHERE doc_id % 8 = 4
UNION ALL SELECT doc_id, 2, '明治', 1, '元' FROM {v_date_text} WHERE doc_id % 8 = 4
UNION ALL SELECT doc_id, 0, '道光', n, cn FROM {v_date_text} WHERE doc_id % 8 = 5
UNION ALL SELECT doc_id, 2, '宣统', 1, '正' FROM {v_date_text} WHERE doc_id % 8 = 5""",
    e1="""
SELECT doc_id, pos, nm.era || num || '年' AS token, 'era' AS kind, nm.era, n, er.a + n - 1 AS year,
  nm.era || num || '年=' || CAST(er.a + n - 1 AS VARCHAR) || '年' || CASE WHEN n > er.b - er.a + 1 THEN '（存疑：' || nm.era || '共' || CAST(er.b - er.a + 1 AS VARCHAR) || '年，无第' || CAST(n AS VARCHAR)
   || '年；该年实为 ' || coalesce(us.used, '（同期无内置年号）') || '）' ELSE '' END AS note
FROM nm JOIN er ON er.era = nm.era LEFT JOIN us ON us.y = er.a + n - 1""",
    g0="""
SELECT doc_id, 0 AS pos, '咸丰' AS era, '' AS sp, gz FROM {v_date_text} WHERE doc_id % 8 = 3
UNION ALL SELECT doc_id, 1, '光緒', '　', gz FROM {v_date_text} WHERE doc_id % 8 = 3""",
    e2="""
SELECT doc_id, pos, g0.era || sp || g0.gz AS token, 'era_gz' AS kind, g0.era, NULL AS n, arg_min(cy.y, CASE WHEN cy.y >= er.a - 1 AND cy.y <= er.a + 70 THEN cy.y - 100000 ELSE abs(cy.y - er.a) END) AS year
FROM g0 JOIN er ON er.era = g0.era JOIN cy ON cy.gz = g0.gz GROUP BY doc_id, pos, g0.era, sp, g0.gz""",
    b0="""
SELECT doc_id, 1 AS pos, gz || '年' AS token, gz FROM {v_date_text} WHERE doc_id % 8 = 0
UNION ALL SELECT doc_id, 2, gz, gz FROM {v_date_text} WHERE doc_id % 8 = 2
UNION ALL SELECT doc_id, 1, gz, gz FROM {v_date_text} WHERE doc_id % 8 = 4""",
    ex="""
SELECT doc_id, pos, token, kind, era, n, year, note FROM e1
UNION ALL SELECT doc_id, pos, token, kind, era, n, year, replace(token, '　', '') || '=' || CAST(year AS VARCHAR) || '年' FROM e2
UNION ALL SELECT doc_id, pos, token, 'gz', NULL, NULL, NULL, b0.gz || '=' || cl.l || '年' FROM b0 JOIN cl ON cl.gz = b0.gz""",
    kept="SELECT * FROM ex WHERE NOT (kind = 'era' AND era = '民国' AND n < 39)",
)


def dated(t: Tables, short: bool) -> DataFrame:
    return M.mentions(t.v_date_text.select("doc_id", "text"), allow_short_republic=short)


@query(
    "dat_01_to_07_mentions",
    oracle(
        "SELECT doc_id, CAST(pos AS BIGINT) AS pos, token, kind, era, CAST(n AS BIGINT) AS n, CAST(year AS BIGINT) AS year, note FROM ex",
        **EXPECTED,
    ),
)
def _mentions(t: Tables) -> DataFrame:
    c = F.col
    return dated(t, True).select(
        "doc_id", c("pos").cast("long").alias("pos"), "token", "kind", "era", c("n").cast("long").alias("n"),
        c("year").cast("long").alias("year"), "note",
    )


@query(
    "dat_02_short_republic_suppressed",
    oracle("SELECT doc_id, token, CAST(year AS BIGINT) AS year FROM kept", **EXPECTED),
)
def _suppressed(t: Tables) -> DataFrame:
    return dated(t, False).select("doc_id", "token", F.col("year").cast("long").alias("year"))


@query(
    "dat_03_overflow_notes",
    oracle("SELECT doc_id, token, note FROM ex WHERE contains(note, '存疑')", **EXPECTED),
)
def _overflow(t: Tables) -> DataFrame:
    return dated(t, True).filter(F.contains("note", F.lit("存疑"))).select("doc_id", "token", "note")


@query(
    "dat_05_bare_cycle_years",
    oracle("SELECT doc_id, token, l AS years FROM b0 JOIN cl ON cl.gz = b0.gz", **EXPECTED),
)
def _bare(t: Tables) -> DataFrame:
    found = dated(t, True).filter("kind = 'gz'")
    return found.select("doc_id", "token", F.array_join(F.col("years").cast("array<string>"), "、").alias("years"))


@query(
    "dat_06_offsets",
    oracle(
        "SELECT doc_id, token, CAST(place AS BIGINT) AS start_at, CAST(place + length(token) AS BIGINT) AS end_at FROM pl",
        **EXPECTED,
        pl="SELECT ex.doc_id, ex.token, CASE WHEN ex.doc_id % 8 = 2 THEN length(v.text) - length(ex.token) WHEN ex.doc_id % 8 = 4 AND pos = 2 THEN 6 ELSE instr(v.text, ex.token) - 1 END AS place FROM ex JOIN {v_date_text} v ON v.doc_id = ex.doc_id",
    ),
)
def _offsets(t: Tables) -> DataFrame:
    found = dated(t, True)
    return found.select("doc_id", "token", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(
    "dat_08_annotated",
    oracle(
        """
SELECT t.doc_id, CASE t.doc_id % 8
  WHEN 0 THEN '于' || t0 || coalesce('【' || k0 || '】', '') || '到' || t1 || '【' || n1 || '】止'
  WHEN 1 THEN t0 || '【' || n0 || '】，又' || t1 || '【' || n1 || '】'
  WHEN 2 THEN text || '【' || n2 || '】'
  WHEN 3 THEN t0 || '【' || n0 || '】、' || t1 || '【' || n1 || '】及甲丑'
  WHEN 4 THEN t0 || '【' || n0 || '】' || t1 || '【' || n1 || '】' || t2 || '【' || n2 || '】'
  WHEN 5 THEN '未闭【' || t0 || '【' || n0 || '】，乾隆〇年，' || t2 || '【' || n2 || '】'
  ELSE text END AS annotated
FROM {v_date_text} t LEFT JOIN a8 ON a8.doc_id = t.doc_id""",
        **EXPECTED,
        a8="""SELECT doc_id, max(token) FILTER (WHERE pos = 0) AS t0, max(token) FILTER (WHERE pos = 1) AS t1, max(token) FILTER (WHERE pos = 2) AS t2,
  max(note) FILTER (WHERE pos = 0) AS n0, max(note) FILTER (WHERE pos = 1) AS n1, max(note) FILTER (WHERE pos = 2) AS n2,
  max(note) FILTER (WHERE pos = 0 AND NOT (kind = 'era' AND era = '民国' AND n < 39)) AS k0 FROM ex GROUP BY doc_id""",
    ),
)
def _annotated(t: Tables) -> DataFrame:
    return t.v_date_text.select("doc_id", M.annotated(F.col("text")).alias("annotated"))


@query(
    "dat_08_note_lists",
    oracle(
        """SELECT t.doc_id, text || coalesce(chr(10) || '【纪年换算】' || l || '。', '') AS noted FROM {v_date_text} t LEFT JOIN (
        SELECT doc_id, string_agg(note, '；' ORDER BY pos) AS l FROM (SELECT doc_id, note, min(pos) AS pos FROM kept GROUP BY 1, 2) GROUP BY doc_id) n USING (doc_id)""",
        **EXPECTED,
    ),
)
def _note_lists(t: Tables) -> DataFrame:
    return t.v_date_text.select("doc_id", M.with_note_list(F.col("text")).alias("noted"))


@query(
    "dat_09_10_year_to_eras",
    oracle(
        """SELECT o_orderkey, d.gz, coalesce(us.used, '') AS eras, coalesce(nr.l, '') AS near FROM (SELECT o_orderkey, CAST(year(o_orderdate) - 100 - o_orderkey % 400 AS BIGINT) AS y FROM orders) o
        LEFT JOIN us USING (y) JOIN (SELECT y, substr('甲乙丙丁戊己庚辛壬癸', CAST((y + 6) % 10 + 1 AS INT), 1) || substr('子丑寅卯辰巳午未申酉戌亥', CAST((y + 8) % 12 + 1 AS INT), 1) AS gz FROM (SELECT range AS y FROM range(1300, 2100))) d USING (y)
        LEFT JOIN (SELECT yr.y, string_agg(er.era, '、' ORDER BY er.a, er.o) AS l FROM yr JOIN er ON NOT er.trad AND er.a <= yr.y AND yr.y <= er.a + 40 GROUP BY yr.y) nr USING (y)""",
        **EXPECTED,
    ),
)
def _year_to_eras(t: Tables) -> DataFrame:
    y = F.year("o_orderdate") - 100 - (F.col("o_orderkey") % 400).cast("int")
    return t.orders.select("o_orderkey", y.alias("y")).select(
        "o_orderkey",
        K.ganzhi_of(F.col("y")).alias("gz"),
        K.eras_text(F.col("y")).alias("eras"),
        F.array_join(K.eras_near(F.col("y")), "、").alias("near"),
    )


@query(
    "dat_11_timeline",
    oracle(
        """SELECT CAST(year AS BIGINT) AS year, era, CAST(count(*) AS BIGINT) AS mentions, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(grouping(year, era) AS BIGINT) AS level
        FROM ex WHERE year IS NOT NULL GROUP BY ROLLUP (year, era)""",
        **EXPECTED,
    ),
)
def _timeline(t: Tables) -> DataFrame:
    line = M.timeline(dated(t, True))
    return line.select(F.col("year").cast("long").alias("year"), "era", "mentions", "documents", F.col("level").cast("long").alias("level"))


@query(
    "dat_12_day_codes",
    oracle("SELECT doc_id, c AS char, d AS day FROM {v_day_text} WHERE doc_id % 5 IN (0, 3) AND c <> '感'"),
)
def _day_codes(t: Tables) -> DataFrame:
    return M.day_mentions(t.v_day_text).select("doc_id", "char", F.col("day").cast("long").alias("day"))


@query(
    "dat_13_day_notes",
    oracle(
        "SELECT doc_id, text || CASE WHEN doc_id % 5 IN (0, 3) AND c <> '感' THEN chr(10) || '【代日韵目：' || c || '=' || CAST(d AS VARCHAR) || '日】' ELSE '' END AS noted FROM {v_day_text}"
    ),
)
def _day_notes(t: Tables) -> DataFrame:
    return t.v_day_text.select("doc_id", M.with_day_note(F.col("text")).alias("noted"))


@query(
    "dat_14_day_table",
    oracle(
        "SELECT CAST(day(ts) AS BIGINT) AS day, CAST(count(*) AS BIGINT) AS events, CAST(max(CASE WHEN day(ts) <= 15 THEN 5 WHEN day(ts) <= 17 THEN 3 WHEN day(ts) <= 29 THEN 2 WHEN day(ts) = 30 THEN 1 ELSE 0 END) AS BIGINT) AS chars, "
        "max(substr('东冬江支微鱼虞齐佳灰真文元寒删铣篠巧皓哿马养梗迥有寝感俭艳卅世', CAST(day(ts) AS INT), 1)) AS common FROM {events} GROUP BY 1"
    ),
)
def _day_table(t: Tables) -> DataFrame:
    per_day = t.events.groupBy(F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    table = M.day_table(K.rhyme_days(t.spark))
    return per_day.join(table, "day").select(F.col("day").cast("long").alias("day"), "events", "chars", "common")
