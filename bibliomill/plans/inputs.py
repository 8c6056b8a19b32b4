"""Derived inputs for the registered queries.

Each is one SQL text that both engines run, over whole tables.  Where the tables hold no
Chinese text, digits of their keys are written as Chinese numerals, so that the values
(and the amount of work) still come from the table.
"""

from __future__ import annotations

from bibliomill.plans.registry import VIEWS

# Search terms of two queries; ``grp`` numbers the groups that must all be met.
VIEWS["v_terms"] = """
SELECT * FROM (VALUES
  (1, 'the', 1, 1), (1, 'and', 2, 1), (1, 'der', 3, 2), (1, 'que', 4, 2),
  (1, 'zzqx-absent', 5, 3), (2, 'the', 1, 1), (2, 'tion', 2, 2)
) AS t(query_id, term, pos, grp)"""

# A document belongs to its source and to the target of its language.
VIEWS["v_membership"] = """
SELECT doc_id, source AS target, CAST(substr(source, 4) AS BIGINT) AS target_pos FROM {documents}
UNION ALL
SELECT doc_id, 'lang-' || lang AS target, CAST(1000 AS BIGINT) AS target_pos FROM {documents}"""

# Text with printed page marks: a mark after every tenth line-free slice is simulated by
# putting one in front of each paragraph.
VIEWS["v_marked"] = """
SELECT doc_id,
  CASE doc_id % 3
    WHEN 0 THEN '第 1 页' || chr(10) || replace(text, chr(10), chr(10) || '第 7 页' || chr(10))
           || chr(10) || '======' || chr(10) || '第 9 页' || chr(10) || '======' || chr(10) || 'tail'
    WHEN 1 THEN replace(text, '. ', '. ≦ 5 ≧')
    ELSE 'http://source.example/' || CAST(doc_id AS STRING) || chr(10) || chr(10) || text
  END AS text
FROM {documents}"""

VIEWS["v_catalog"] = """
SELECT doc_id,
  'lib' || CAST(CAST(floor(doc_id / 40) AS BIGINT) % 3 AS STRING) AS root,
  'lib' || CAST(CAST(floor(doc_id / 40) AS BIGINT) % 3 AS STRING) || '/shelf' || CAST(floor(doc_id / 40) AS BIGINT) AS dir,
  CASE doc_id % 8
    WHEN 0 THEN 'Book ' || CAST(floor(doc_id / 8) AS BIGINT) || '.pdf'
    WHEN 1 THEN 'Book ' || CAST(floor(doc_id / 8) AS BIGINT) || '_opt.txt'
    WHEN 2 THEN 'Book ' || CAST(floor(doc_id / 8) AS BIGINT) || '_OCR.txt'
    WHEN 3 THEN 'Book ' || CAST(floor(doc_id / 8) AS BIGINT) || '_【繁转简】.TXT'
    WHEN 4 THEN '近代史料丛刊 第' || translate(CAST(CAST(floor(doc_id / 8) AS BIGINT) % 90 + 1 AS STRING), '0123456789', '〇一二三四五六七八九')
                || '辑_' || CAST(10000000 + doc_id AS STRING) || '_PD6AIFOCR.pdf'
    WHEN 5 THEN '近代史料丛刊 第' || translate(CAST(CAST(floor(doc_id / 8) AS BIGINT) % 90 + 1 AS STRING), '0123456789', '〇一二三四五六七八九')
                || '辑_PDV5AIOCR_【简转繁】.txt'
    WHEN 6 THEN '续考' || translate(CAST(CAST(floor(doc_id / 16) AS BIGINT) AS STRING), '0123456789', '〇一二三四五六七八九')
                || '_郑良树编著_台湾学生书局' || CAST(1950 + doc_id % 50 AS STRING) || '年（上）.pdf'
    ELSE '李泽厚：美的历程' || CAST(CAST(floor(doc_id / 8) AS BIGINT) % 20 AS STRING) || '（全' || CAST(doc_id % 5 + 1 AS STRING)
         || '册）（北京 文物出版社1981年）.epub'
  END AS name,
  n_chars AS size,
  CAST(1700000000 + doc_id AS DOUBLE) AS mtime
FROM {documents}"""

VIEWS["v_old"] = "SELECT * FROM {v_catalog} WHERE doc_id % 10 <> 0"
VIEWS["v_new"] = """
SELECT doc_id, root, dir, name, size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size,
  mtime + CASE WHEN doc_id % 11 = 0 THEN 0.5 WHEN doc_id % 13 = 0 THEN -5 ELSE 0 END AS mtime
FROM {v_catalog} WHERE doc_id % 10 <> 1 AND root <> 'lib2'"""

# Locations of web pages as a foreign listing.
VIEWS["v_urls"] = """
SELECT page_id, url,
  regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path,
  length(html) AS size
FROM {pages}"""

VIEWS["v_targets"] = """
SELECT s_suppkey, 'target ' || CAST(s_suppkey AS STRING) AS target,
  CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE
    'lib' || CAST(s_suppkey % 4 AS STRING) || '/shelf' || CAST(s_suppkey % 30 AS STRING) || '/;LIB1/Shelf'
    || CAST(s_suppkey % 26 AS STRING) || ';; lib9/gone' || CAST(s_suppkey % 4 AS STRING) END AS location,
  s_suppkey % 5 <> 0 AS store_exists,
  'store/' || CAST(s_suppkey AS STRING) AS store
FROM {supplier}"""

VIEWS["v_watch"] = """
SELECT n_nationkey AS pos, n_name AS key,
  'lib' || CAST(n_nationkey % 4 AS STRING) || '/shelf' || CAST(n_nationkey AS STRING) AS expected,
  n_nationkey % 3 <> 0 AS main,
  CASE n_nationkey % 3 WHEN 0 THEN 'optional' WHEN 1 THEN 'critical' ELSE 'dual' END AS level
FROM {nation}"""

VIEWS["v_present"] = "SELECT DISTINCT dir FROM {v_catalog}"

# Members of a group are suppliers of one nation; one member in seven is misspelt.
VIEWS["v_groups"] = """
SELECT 'group ' || CAST(s_nationkey AS STRING) AS name,
  'target ' || CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 7 = 0 THEN '?' ELSE '' END AS member,
  s_suppkey AS member_pos
FROM {supplier}"""

VIEWS["v_asked"] = """
SELECT CAST(c_custkey AS BIGINT) AS pos,
  CASE WHEN c_custkey % 5 = 0 THEN 'group ' || CAST(c_nationkey AS STRING)
       ELSE 'target ' || CAST(c_custkey % 150 AS STRING) END AS name
FROM {customer}"""

# Dictionary lines: numbered names with spellings, repeated heads, names claimed twice.
VIEWS["v_alias_lines"] = """
SELECT 'main' AS source, 0 AS source_rank, p_partkey AS line_no,
  CASE WHEN p_partkey % 50 = 0 THEN '# remark, not, a line'
       WHEN p_partkey % 41 = 0 THEN '  lonely' || CAST(p_partkey AS STRING) || ' , '
       ELSE CASE p_partkey % 5 WHEN 0 THEN 'namé' WHEN 1 THEN ' nème' ELSE 'name' END || CAST(p_partkey % 300 AS STRING)
         || substr('，,、；;/|', CAST(p_partkey % 7 + 1 AS INT), 1) || 'alias' || CAST(p_partkey % 97 AS STRING)
         || ' , nick' || CAST(p_partkey AS STRING) || ';name' || CAST(p_partkey * 7 % 300 AS STRING)
         || '/alias' || CAST(p_partkey % 97 AS STRING) END AS line
FROM {part}
UNION ALL
SELECT 'place' AS source, 1 AS source_rank, s_suppkey AS line_no,
  CASE s_suppkey % 3 WHEN 0 THEN 'name' || CAST(s_suppkey % 300 AS STRING) WHEN 1 THEN 'town' || CAST(s_suppkey AS STRING)
    ELSE 'alias' || CAST(s_suppkey % 97 AS STRING) END
  || ',place' || CAST(s_suppkey AS STRING) || ',nick' || CAST(s_suppkey * 3 AS STRING) || ',é,towné' || CAST(s_suppkey AS STRING)
  || CASE WHEN s_suppkey % 9 = 1 THEN '、tówn,town' || CAST(s_suppkey AS STRING) ELSE '' END AS line
FROM {supplier}
UNION ALL
SELECT 'org' AS source, 2 AS source_rank, c_custkey AS line_no,
  'town' || CAST(c_custkey % 120 AS STRING) || '|bureau' || CAST(c_custkey AS STRING) || '|nick' || CAST(c_custkey AS STRING) AS line
FROM {customer}"""

VIEWS["v_alias_terms"] = """
SELECT DISTINCT term FROM (
  SELECT CASE p_partkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'namé' ELSE 'alias' END || CAST(p_partkey % 300 AS STRING) AS term FROM {part}
  UNION ALL SELECT 'nick' || CAST(p_partkey AS STRING) FROM {part} WHERE p_partkey % 4 = 0
  UNION ALL SELECT 'town' || CAST(s_suppkey AS STRING) FROM {supplier}
  UNION ALL SELECT 'nowhere' || CAST(c_custkey AS STRING) FROM {customer} WHERE c_custkey % 10 = 0) AS u"""

VIEWS["v_user_alias"] = """
SELECT 'name' || CAST(c_custkey % 300 AS STRING) AS word, c_custkey AS pos, 'own' || CAST(c_custkey AS STRING) AS alias
FROM {customer} WHERE c_custkey % 4 = 0"""

VIEWS["v_blocked"] = """
SELECT 'name' || CAST(p_partkey % 300 AS STRING) AS block_key, 'nick' || CAST(p_partkey AS STRING) AS alias FROM {part} WHERE p_partkey % 6 = 0
UNION ALL
SELECT DISTINCT 'name' || CAST(p_partkey % 300 AS STRING) AS block_key, 'nèmè' || CAST(p_partkey % 300 AS STRING) AS alias FROM {part} WHERE p_partkey % 300 < 50"""

# Colophons of every document: four lines put after its line doc_id mod 20.
VIEWS["v_colophon"] = """
SELECT doc_id, lang,
  CASE WHEN doc_id % 6 = 5 THEN text ELSE
    replace(text, chr(10), chr(10) || '卷首语' || chr(10)) || chr(10)
    || CASE doc_id % 6
      WHEN 0 THEN '图书在版编目（CIP）数据' || chr(10) || '美的历程' || translate(CAST(doc_id AS STRING), '0123456789', '〇一二三四五六七八九')
           || '／李泽厚著．—北京：文物出版社，' || CAST(1950 + doc_id % 60 AS STRING) || '.3' || chr(10) || 'ISBN ７-5010-0000-0' || chr(10) || '定价：2.00元'
      WHEN 1 THEN '冯玉祥传略' || chr(10) || '（内部资料）' || chr(10) || '王某某 张三丰编著' || chr(10) || '中華書局' || chr(10)
           || CAST(1950 + doc_id % 60 AS STRING) || '年5月第1版　1999年6月第1次印刷' || chr(10) || '统一书号 11018·1000'
      WHEN 2 THEN '本书由中华书局授权出版发行' || chr(10) || '版权所有：中华书局' || chr(10) || 'ISBN 978-7-101-00000-1' || chr(10)
           || CAST(1950 + doc_id % 60 AS STRING) || '年3月第1版，第2次印刷'
      WHEN 3 THEN '山川志' || chr(10) || '四川省社会科学院某某出版社出版' || chr(10) || '出版日期 ' || CAST(1950 + doc_id % 60 AS STRING) || chr(10) || '四川某某出版社'
      ELSE '商务印书馆' || chr(10) || '上海商务印书馆出版 ' || CAST(1950 + doc_id % 60 AS STRING) || '年初印刷' || chr(10) || '印数 1-3000册'
    END || chr(10) || '書學國會' || CASE WHEN doc_id % 4 = 0 THEN '书学国会发录' ELSE '' END
  END AS text
FROM {documents}"""

VIEWS["v_publishers"] = """
SELECT * FROM (VALUES (1, '文物出版社', '北京'), (2, '中华书局', '北京'), (3, '商务印书馆', '北京'), (4, '上海商务印书馆', '上海'),
  (5, '台湾学生书局', '台北'), (6, '文物出版社', '第二个'), (7, '黄山书社', '合肥')) AS p(pos, publisher, city)"""

# Dates in words from the order table: reign years in digits and numerals, cycle names,
# reign with cycle, years beyond a reign, and text that must be passed over.
VIEWS["v_dates"] = """
SELECT o_orderkey AS doc_id, n, y,
  substr('甲乙丙丁戊己庚辛壬癸', CAST((y + 6) % 10 + 1 AS INT), 1) || substr('子丑寅卯辰巳午未申酉戌亥', CAST((y + 8) % 12 + 1 AS INT), 1) AS gz,
  CASE WHEN n < 10 THEN '' WHEN n < 20 THEN '十' ELSE substr('一二三四五六七八九', CAST(floor(n / 10) AS INT), 1) || '十' END
    || CASE WHEN n % 10 = 0 THEN '' ELSE substr('一二三四五六七八九', CAST(n % 10 AS INT), 1) END AS cn
FROM (SELECT o_orderkey, CAST(1 + o_orderkey % 60 AS BIGINT) AS n, CAST(year(o_orderdate) - 100 AS BIGINT) AS y FROM {orders}) AS o"""

VIEWS["v_date_text"] = """
SELECT doc_id, n, y, gz, cn,
  CASE doc_id % 8
    WHEN 0 THEN '于民国' || CAST(n AS STRING) || '年到' || gz || '年止'
    WHEN 1 THEN '光绪' || cn || '年，又康熙' || CAST(n + 20 AS STRING) || '年'
    WHEN 2 THEN '【光绪' || cn || '年】见' || gz || '【注】与' || gz
    WHEN 3 THEN '咸丰' || gz || '、光緒　' || gz || '及甲丑'
    WHEN 4 THEN '明治元年' || gz || '明治元年'
    WHEN 5 THEN '未闭【道光' || cn || '年，乾隆〇年，宣统正年'
    ELSE '无纪年之文' || CAST(n AS STRING) END AS text
FROM {v_dates}"""

VIEWS["v_day_text"] = """
SELECT event_id AS doc_id, d,
  CASE event_id % 5 WHEN 0 THEN '接' || c || '电，又' || c || '电' WHEN 1 THEN '没' || c || '电' WHEN 2 THEN c || '电文三件'
    WHEN 3 THEN '今日送电与' || c || '电' ELSE '通电' END AS text, c
FROM (SELECT event_id, CAST(day(ts) AS BIGINT) AS d,
  substr('东冬江支微鱼虞齐佳灰真文元寒删铣篠巧皓哿马养梗迥有寝感俭艳卅世', CAST(day(ts) AS INT), 1) AS c FROM {events}) AS e"""

# A notebook per conversation turn: one record with a note, one old record without.
VIEWS["v_notebook"] = """
SELECT conv_id * 1000 + turn AS notebook, conv_id, turn, text,
  '# 摘录本' || chr(10) || chr(10) || '> 前言' || chr(10) || chr(10)
  || '### 摘录 · 2026-01-01 00:00:' || CAST(10 + turn % 50 AS STRING) || chr(10)
  || '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || '>' || chr(10) || '> 第二段' || chr(10) || '>' || chr(10)
  || '> —— 《书' || CAST(conv_id AS STRING) || '》第3页' || chr(10) || '> 张三｜版本：PDF原本' || chr(10)
  || '<!-- cv:src=D:/库/' || CAST(conv_id AS STRING) || '.pdf|page=' || CAST(turn + 1 AS STRING) || '|fn=' || CAST(conv_id AS STRING)
  || '.pdf|sz=' || CAST(length(text) AS STRING) || '|np=12|cite=引文｜全 -->' || chr(10)
  || chr(10) || '### 摘录 · old' || chr(10) || chr(10) || '>旧文' || CAST(turn AS STRING) || chr(10) || '>' || chr(10) || chr(10)
  || '> 《旧书' || CAST(conv_id % 7 AS STRING) || '》第 ' || CAST(turn + 4 AS STRING) || ' 頁'
  || CASE WHEN turn % 2 = 0 THEN '｜文件：某库/旧' || CAST(conv_id AS STRING) || '.TXT' ELSE '' END || chr(10) AS md
FROM {conversations}"""

VIEWS["v_snapshots"] = """
SELECT conv_id * 1000 + turn AS notebook, conv_id, turn, text,
  '# 截图本' || chr(10) || '### 书' || CAST(conv_id AS STRING) || ' · 卷一 · 2025-01-01' || chr(10)
  || '![图](img/' || CAST(turn AS STRING) || ' (1).png)' || chr(10) || '> 出处一' || chr(10) || '> 出处二' || chr(10)
  || CASE WHEN turn % 2 = 0 THEN '> 截图时间：2025-02-02 10:00' || chr(10) ELSE '' END
  || '> 页码：第3页' || chr(10) || '> 备注：注' || CAST(conv_id AS STRING) || chr(10) || '>' || chr(10) || '> 【下面这段文字】' || chr(10)
  || '> 正文甲' || chr(10) || '> 正文乙' || CAST(turn AS STRING) || chr(10) || '<!-- cv:src=S|page=3|fn=f.pdf -->' || chr(10) AS md
FROM {conversations}"""
