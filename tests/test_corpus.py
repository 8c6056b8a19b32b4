"""Catalog, pages, search, relocation, notebooks, files and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bibliomill.operators import catalog as C
from bibliomill.operators import notebook as B
from bibliomill.operators import paging as P
from bibliomill.operators import redact as R
from bibliomill.operators import relocate as L
from bibliomill.operators import search as S
from bibliomill.functions.ranking import numbered
from bibliomill.sources import files as X
from bibliomill.sources.publish import PublishError, current, publish, versions
from bibliomill.streaming import jobs as J

MARKED = (
    "元数据头\n2016-07-02 04:08:54\nhttp://x\n======\n第 1 页\n第一页正文甲。\n======\n第 2 页\n第二页正文乙。\n"
    "======\n第 3 页\n第三页正文丙丙丙。\n======\n第 4 页\n第四页正文丁。\n"
)


def test_inventory_search_and_refresh(spark, tmp_path):
    root = tmp_path / "书库"
    deep = root / "子库" / "孙目录"
    deep.mkdir(parents=True)
    (root / "node_modules").mkdir()
    for n in ("甲书.pdf", "甲书_【繁转简】.txt", "乙书_PD6AIFOCR.pdf", "丙书.epub", "说明.docx", "忽略我.bin", "node_modules/x.pdf"):
        (root / n).write_bytes(b"x" * 32)
    (deep / "丁书.epub").write_bytes(b"x" * 32)
    roots = [str(root), str(tmp_path / "absent")]
    first = X.inventory(spark, roots)
    old = spark.createDataFrame(first.collect(), first.schema)
    assert old.count() == 6
    kws = spark.createDataFrame([("甲书",), ("丁书",), ("忽略我",), ("孙目录",)], "kw string")
    got = {r["kw"]: r["n"] for r in C.name_search(old, kws).groupBy("kw").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"甲书": 2, "丁书": 1, "孙目录": 1}
    (deep / "戊书.pdf").write_bytes(b"x" * 48)
    (root / "丙书.epub").unlink()
    new = X.inventory(spark, roots)
    counts = {r["action"]: r["files"] for r in C.diff_counts(C.snapshot_diff(old, new)).collect()}
    assert counts == {"same": 5, "add": 1, "delete": 1}
    after = C.apply_diff(C.snapshot_diff(old, new)).select("dir", "name").collect()
    assert {tuple(r) for r in after} == {tuple(r) for r in new.select("dir", "name").collect()}
    gone = X.inventory(spark, [str(tmp_path / "absent")])
    assert {r["action"] for r in C.snapshot_diff(old, gone).collect()} == {"held"}


def test_marked_pages_and_offsets(spark):
    docs = spark.createDataFrame([(1, MARKED), (2, "≦1≧\n甲\n≦2≧\n乙\n≦3≧\n丙\n"), (3, ""), (4, "≦１≧\n\n≦２≧ \n≦３≧\n")], "doc_id int, text string")
    pages = P.text_pages(docs).collect()
    by = {d: [(r["page"], r["text"].strip()) for r in pages if r["doc_id"] == d] for d in (1, 2, 3, 4)}
    assert [p for p, _ in by[1]] == [1, 2, 3, 4] and by[1][1][1] == "第二页正文乙。"
    assert by[2] == [(1, "甲"), (2, "乙"), (3, "丙")] and by[3] == []
    assert [p for p, _ in by[4]] == [1]
    spans = P.page_spans(docs)
    for r in spans.filter("doc_id = 1").collect():
        assert MARKED[r["start"] : r["end"]].strip() == dict(by[1])[r["page"]]
    asked = spark.createDataFrame([(1, 2), (1, 9), (1, 0)], "doc_id int, number int")
    got = {r["number"]: r for r in P.offset_of_page(asked, spans).collect()}
    assert got[2]["found"] == 2 and got[9]["found"] == 4 and got[0]["found"] == 1
    pos = spark.createDataFrame([(1, got[2]["offset"]), (1, 0), (1, 10_000)], "doc_id int, pos long")
    at = {r["pos"]: r["page_at"] for r in P.pages_at(pos, spans).collect()}
    assert at == {got[2]["offset"]: 2, 0: 1, 10_000: 4}


def test_chunks_skip_the_header(spark):
    body = "正" * 1201
    docs = spark.createDataFrame([(1, "\n2016-07-02 04:08:54\nhttp://x\n" + body), (2, body)], "doc_id int, text string")
    got = {(r["doc_id"], r["page"]): len(r["text"]) for r in P.text_pages(docs).collect()}
    assert got == {(d, p): n for d in (1, 2) for p, n in ((1, 500), (2, 500), (3, 201))}


def test_joined_search_equals_constant_search(spark):
    rows = [(i, 0, 1, f"甲{i % 7}乙 the{i} 丙" * 3) for i in range(60)]
    pages = spark.createDataFrame(rows, "doc_id int, ord int, page int, text string")
    terms = spark.createDataFrame([(f"the{i}", i) for i in range(0, 60, 3)] + [("丙", 90), ("乙 t", 91), ("无", 92)], "term string, pos int")
    few = {tuple(r) for r in S.page_hits(pages, terms).select("doc_id", "term", "count").collect()}
    many = {tuple(r) for r in S.page_hits(pages, terms, limit=2).select("doc_id", "term", "count").collect()}
    brute = {(d, t["term"], x.count(t["term"])) for d, _, _, x in rows for t in terms.collect() if t["term"] in x}
    assert few == many == brute


def test_loose_search_crosses_line_ends(spark):
    pages = spark.createDataFrame([(1, 0, 1, "見遜\n志\u3000堂\ufffd雜鈔。遜志堂"), (2, 0, 1, "a.b")], "doc_id int, ord int, page int, text string")
    terms = spark.createDataFrame([("遜志堂", 1), ("a.b", 2), ("axb", 3)], "term string, pos int")
    got = {r["term"]: (r["count"], r["start"], r["span"]) for r in S.loose_hits(pages, terms).collect()}
    assert got == {"遜志堂": (2, 1, 5), "a.b": (1, 0, 3)}


def test_history_keeps_the_latest_of_each_term(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    h = spark.createDataFrame([(1, "甲", t(1)), (1, "乙", t(2)), (1, "甲", t(3))], "user_id int, kw string, ts timestamp")
    assert [r["kw"] for r in S.recent_terms(h).orderBy("pos").collect()] == ["甲", "乙"]


def test_numbering_of_a_hot_group_is_exact(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.md5(F.col("id").cast("string")).alias("name"))
    got = numbered(rows, ["k"], [F.col("name")], "no").filter("k = 'hot'").orderBy("name").collect()
    assert [r["no"] for r in got] == list(range(1, len(got) + 1)) and len(got) == 1333


def test_longest_rule_with_boundary(spark):
    rules = spark.createDataFrame(
        [("a", r"D:\库", r"E:\甲", True), ("b", r"D:\库\网盘", r"F:\乙", True), ("c", r"X:\旧", r"X:\新", False), ("d", "Y:\\根\\", "Z:\\根\\", True)],
        "key string, expected string, actual string, translated boolean",
    )
    paths = [r"d:\库\a.pdf", r"D:\库\网盘\b.pdf", r"D:\库2\c.pdf", r"X:\旧\d.pdf", "Y:\\根\\e.pdf", r"D:\库"]
    want = [r"E:\甲\a.pdf", r"F:\乙\b.pdf", r"D:\库2\c.pdf", r"X:\旧\d.pdf", "Z:\\根\\e.pdf", r"E:\甲"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for limit in (512, 1):
        got = {r["path"]: (r["new_path"], r["label"]) for r in L.relocated(df, rules, limit=limit).collect()}
        assert [got[p][0] for p in paths] == want
        assert got[paths[0]][1] == "路径已转译：D: → E:" and got[paths[2]][1] == ""


NOTEBOOK = (
    "# 摘录本\n\n### 摘录 · 2026-01-01 00:00:00\r\n> 人的觉醒\r\n>\r\n> 第二段\r\n>\r\n> —— 《美的历程》第27页\r\n> 版本：PDF原本\r\n"
    "<!-- cv:src=D:/a.pdf|page=27|fn=a.pdf|sz=12|np=3|cite=李泽厚：《美的历程》 -->\r\n"
    "\n### 摘录 · old\n> 旧\n>\n> 《别史》第 9 頁｜文件：x/y.txt\n"
)


def test_notebook_round_trip_keeps_fingerprints(spark):
    df = spark.createDataFrame([("n", NOTEBOOK)], "notebook string, md string")
    recs = B.parse_excerpts(df)
    a, b = recs.orderBy("block_no").collect()
    assert a["body"] == "人的觉醒\n\n第二段" and a["cite"].startswith("—— 《美的历程》") and (a["src"], a["page"], a["fn"], a["size"], a["npages"]) == ("D:/a.pdf", "27", "a.pdf", "12", "3")
    assert a["cite_std"] == "李泽厚：《美的历程》" and (b["file_hint"], b["page"]) == ("y.txt", "9")
    again = B.parse_excerpts(B.notebook_markdown(recs)).orderBy("block_no").collect()
    assert [r.asDict() for r in again] == [a.asDict(), b.asDict()]
    edited = recs.withColumn("body", F.concat(F.lit("（改过的）"), "body")).unionByName(
        recs.limit(1).withColumn("block_no", F.lit(9)).withColumn("body", F.lit("手工新增一条。"))
    )
    assert B.parse_excerpts(B.notebook_markdown(edited)).count() == 3


def test_decoding(spark):
    rows = [("a", "中文".encode("gb18030"), None), ("b", "中文".encode("utf-8-sig"), None), ("c", "繁體".encode("big5"), "big5"), ("d", b"\xff\xfe\xfa", None), ("e", "中文".encode("gbk"), "GB2312"), ("f", "é".encode(), "latin-1")]
    df = spark.createDataFrame(rows, "k string, b binary, h string")
    got = {r["k"]: r["t"] for r in df.select("k", X.decoded(F.col("b"), F.col("h")).alias("t")).collect()}
    assert got["a"] == got["b"] == got["e"] == "中文" and got["c"] == "繁體" and got["f"] == "Ã©" and "\ufffd" in got["d"]


def test_truncated_results_keep_complete_items(spark, tmp_path):
    ns = 'xmlns:r="urn:results"'
    item = lambda n, folder: f'<r:file r:isfolder="{folder}"><r:name>{n}</r:name><r:path>D:\\库</r:path><r:sizebytes>5</r:sizebytes></r:file>'
    (tmp_path / "r.xml").write_text(f"<r:results {ns}>{item('a.pdf', 'false')}{item('夹', 'true')}<r:file><r:name>b", encoding="utf-8")
    assert {r["path"] for r in X.read_results(spark, str(tmp_path / "r.xml")).collect()} == {"D:\\库\\a.pdf"}
    assert {r["path"] for r in X.read_results(spark, str(tmp_path / "r.xml"), include_folders=True).collect()} == {"D:\\库\\a.pdf", "D:\\库\\夹"}
    items = spark.createDataFrame([("<file isfolder='false'><name>a.pdf</name><path>D:\\库\\</path></file>",), ("<file><name>b",)], "item string")
    assert [r["path"] for r in X.parse_results(items).collect()] == ["D:\\库\\a.pdf"]


def test_dictionary_files_keep_line_order(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("\ufeff# x\n甲,乙\n\n丙；丁|戊\n".encode())
    rows = X.read_dictionary(spark, [("main", str(tmp_path / "m.csv"))]).collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(0, "# x"), (1, "甲,乙"), (2, ""), (3, "丙；丁|戊")]


def test_failed_publication_stays_unseen(spark, tmp_path):
    base = str(tmp_path / "t")
    assert current(spark, base) is None
    publish(spark.range(5), base)
    with pytest.raises(PublishError):
        publish(spark.range(7), base, expected_rows=8)
    assert current(spark, base).count() == 5 and versions(spark, base).count() == 1
    publish(spark.range(7), base, replica=str(tmp_path / "r"))
    assert current(spark, base).count() == 7 and current(spark, str(tmp_path / "r")).count() == 7


def test_redaction_protects_tokens(spark):
    docs = spark.createDataFrame([(1, "C:/me/x me@site me2"), (2, "clean")], "doc_id int, text string")
    rules = spark.createDataFrame([(2, "me", "<user>"), (1, "C:/me", "X:")], "rank int, old string, new string")
    got = {r["doc_id"]: r["text"] for r in R.redact(docs, rules, ["me@site"]).collect()}
    assert got == {1: "X:/x me@site <user>2", 2: "clean"}
    words = spark.createDataFrame([(1, "zz"), (2, "me")], "rank int, word string")
    assert [tuple(r) for r in R.leaks(docs, words, ["me@site"]).collect()] == [(1, "me")]


def test_repeated_refresh_changes_nothing(spark, tmp_path):
    base, inbox = str(tmp_path / "cat"), str(tmp_path / "in")
    schema = "root string, dir string, name string, size long, mtime double"
    spark.createDataFrame([("r", "d", "a", 1, 10.0), ("r", "d", "b", 1, 10.0)], schema).write.parquet(inbox)
    for i, rows in enumerate(([("r", "d", "a", 2, 20.0)], [("r", "d", "a", 2, 20.0), ("r", "d", "c", 1, 5.0)])):
        stream = spark.readStream.schema(schema).parquet(inbox)
        J.refresh_catalog(stream, base, str(tmp_path / f"ck{i}")).awaitTermination()
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
    J.refresh_catalog(spark.readStream.schema(schema).parquet(inbox), base, str(tmp_path / "ck2")).awaitTermination()
    assert sorted(tuple(r) for r in current(spark, base).select("name", "size").collect()) == [("a", 2), ("b", 1), ("c", 1)]


def test_one_directory_fills_several_ranges(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), F.concat(F.lit("a name of forty characters that all share "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"))
    got = numbered(rows, ["k"], [F.col("name")], "no").collect()
    assert sorted((r["no"], r["name"]) for r in got) == [(i + 1, n) for i, n in enumerate(sorted(r["name"] for r in got))]
    ranges = rows.repartitionByRange(4, "k", "name").withColumn("p", F.spark_partition_id())
    assert ranges.select("p").distinct().count() == 4


def test_roots_with_scheme_and_relative_roots(spark):
    from bibliomill.operators.catalog import kept_files

    rows = [("s3a://bucket/lib", "s3a://bucket/lib/.git/x.pdf"), ("s3a://bucket/lib", "s3a://bucket/lib/a/x.pdf"), ("/data/.hidden/lib/", "/data/.hidden/lib/x.pdf"), ("file:///lib", "/lib/node_modules/x.pdf"), ("/lib", "file:/lib/x.pdf"), ("lib", "lib/__pycache__/x.pdf"), ("lib", "lib/b/x.pdf")]
    kept = kept_files(spark.createDataFrame(rows, "root string, path string"))
    assert {r["path"] for r in kept.collect()} == {"s3a://bucket/lib/a/x.pdf", "/data/.hidden/lib/x.pdf", "file:/lib/x.pdf", "lib/b/x.pdf"}


def test_long_rule_lists_give_what_short_ones_give(spark):
    from bibliomill.operators import redact as R

    docs = spark.createDataFrame([(1, "k1 k2 k700 me@k5")], "doc_id int, text string")
    rules = spark.range(1, 800).select(F.col("id").alias("rank"), F.concat(F.lit("k"), F.col("id")).alias("old"), F.concat(F.lit("<"), F.col("id"), F.lit(">")).alias("new"))
    long = R.redact(docs, rules, ["me@k5"]).first()["text"]
    assert long == R.redact(docs, rules.filter("rank < 10"), ["me@k5"]).first()["text"].replace("<7>00", "<7>00") == "<1> <2> <7>00 me@k5"


def test_full_width_words_make_a_colophon(spark):
    from bibliomill.operators import biblio as B

    text = "\n".join(["line"] * 200 + ["ＩＳＢＮ 7-5010-0000-0"] + ["line"] * 5)
    row = B.colophons(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row["at_line"] == 189


def test_terms_that_differ_in_case_are_one(spark):
    from bibliomill.operators import search as S

    pages = spark.createDataFrame([(1, 0, "The the THE")], "doc_id int, ord int, text string")
    terms = spark.createDataFrame([("The", 1), ("the", 2)], "term string, pos int")
    assert [(r["term"], r["pos"], r["count"]) for r in S.page_hits(pages, terms, case_insensitive=True).collect()] == [("the", 1, 3)]


def test_names_asked_again_meet_their_group_once(spark):
    from bibliomill.operators import catalog as C

    asked = spark.createDataFrame([(i, "group" if i % 2 else f"t{i}") for i in range(20)], "pos long, name string")
    members = spark.createDataFrame([("group", f"t{i}", i) for i in range(6)], "group string, member string, member_pos int")
    df = C.resolve_targets(asked, members)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [name" in plan[plan.find("Join") :]
    got = {r["target"]: r["pos"] for r in df.collect()}
    assert got == {**{f"t{i}": i for i in range(8, 20, 2)}, **{f"t{i}": 0 if i == 0 else 1 for i in range(6)}, "t6": 6}
