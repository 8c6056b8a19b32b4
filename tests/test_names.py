"""Names of files: keys, fields, editions, citations."""

from pyspark.sql import functions as F

from bibliomill.functions import names as N
from bibliomill.functions import text as X
from bibliomill.operators import biblio as B
from bibliomill.operators import editions as E

SURNAMES = "李邓王冯郑布"
CASES = [
    ("孙中山全集 第三册_10490188_PD6AIFOCR.pdf", {"volume": "第三册", "ssid": "10490188"}),
    ("鲒埼亭集_PDVL6AIFOCR_【繁转简】.txt", {"tail": "_【繁转简】"}),
    ("第3辑外交_PDV5AIFOCR.txt", {"title": "第3辑外交", "volume": "第3辑"}),
    ("第3辑外交_PDV5AIFOCR_【简转繁】.txt", {"title": "第3辑外交"}),
    ("第3辑外交_OCR_PD5AIOCR.pdf", {"title": "第3辑外交"}),
    ("中国伪书综考（全1册）（邓瑞全 王冠英编著 合肥 黄山书社1998年）.pdf", {"volume": "全1册", "author": "王冠英"}),
    ("近代中国史料丛刊三辑 0427 冯宫保（子材）军牍集要（一）_PD6AIFOCR.pdf", {"volume": "（一）"}),
    ("布罗代尔：十五至十八世纪的物质文明 第1卷_14296873_layered.pdf", {"ssid": "14296873", "volume": "第1卷", "author": "布罗代尔"}),
    ("续伪书通考_郑良树编著_台湾学生书局1984年.pdf", {"author": "郑良树", "publisher": "台湾学生书局", "year": "1984"}),
    (".hidden", {"ext": "", "title": ".hidden".strip(".")}),
]


def test_name_fields(spark):
    df = spark.createDataFrame([(n,) for n, _ in CASES], "name string")
    got = {r["name"]: r for r in N.parse_names(df, SURNAMES).collect()}
    for name, want in CASES:
        assert {k: got[name][k] for k in want} == want, name


def test_families_join_engines_and_scripts(spark):
    names = [
        "第3辑外交_OCR.txt", "第3辑外交_OCR_PD5AIOCR.pdf", "第3辑外交_PDV5AIFOCR.txt", "第3辑外交_PDV5AIFOCR_【简转繁】.txt",
        "X_PDV6AIFOCR.pdf", "X_PDV6AIOCR_【繁转简】.txt", "X_PDVL6AIFOCR.txt",
        "某书_11222324_AIFOCR_opt.pdf", "某书11222324_AIFOCR.txt",
    ]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = df.select("name", N.family_key(F.col("name")).alias("f"), N.book_core(F.col("name")).alias("c")).collect()
    fam = {r["name"]: r["f"] for r in rows}
    assert {fam[n] for n in names[:4]} == {"第3辑外交"}
    assert {fam[n] for n in names[4:7]} == {"x"}
    assert fam[names[7]] == fam[names[8]]
    assert {r["c"] for r in rows if r["name"].startswith("第3")} == {"第3辑外交"}


def test_editions_and_citation(spark):
    files = [
        "布罗代尔：十五至十八世纪的物质文明 第1卷_14296873_layered.pdf",
        "布罗代尔：十五至十八世纪的物质文明 第1卷_14296873_【繁转简】.txt",
        "布罗代尔：十五至十八世纪的物质文明 第1卷_PD6AIFOCR.pdf",
    ]
    r = N.parse_names(spark.createDataFrame([(n,) for n in files], "name string"), SURNAMES).withColumn("path", F.col("name"))
    groups = E.edition_groups(r).collect()
    assert len(groups) == 1 and groups[0]["versions"] == 3 and groups[0]["first_path"].endswith(".pdf")
    order = E.version_order(r.select("title", "volume", "tail", "ext", "path", "name")).orderBy("version_no").collect()
    assert [o["ext"] for o in order] == [".pdf", ".pdf", ".txt"]
    e = F.lit("")
    c = r.limit(1).select(B.citation(F.col("title"), F.col("volume"), F.col("author"), e, e, e, F.lit("27")).alias("c"))
    text = c.first()["c"]
    assert text.startswith("布罗代尔：《十五至十八世纪的物质文明") and text.endswith("第27页。")


def test_related_works(spark):
    rows = [
        ("近代中国史料丛刊 001 甲篇", "D:/库/近代史料", "a.pdf", "邓瑞全"),
        ("近代中国史料丛刊 002 乙篇", "D:/库/近代史料", "b.pdf", "王某"),
        ("别史", "D:/库/别处", "c.pdf", "邓瑞全"),
        ("近代中国史料丛刊 001 甲篇", "D:/库/近代史料", "a2.txt", "邓瑞全"),
    ]
    books = spark.createDataFrame(rows, "name string, dir string, path string, author string")
    got = {}
    for r in E.related_works(books).filter("path = 'a.pdf'").collect():
        got.setdefault(r["class"], set()).add(r["related"])
    assert got["series"] == {"b.pdf", "a2.txt"} and got["topic"] == {"b.pdf", "a2.txt"}
    assert got["same_author"] == {"c.pdf", "a2.txt"} and got["same_book"] == {"a2.txt"}


def test_related_works_cap_is_exact(spark):
    books = spark.range(130).select(
        F.lit("同名丛书").alias("name"), F.lit("/d").alias("dir"), F.format_string("%03d", "id").alias("path"), F.lit("").alias("author")
    )
    got = E.related_works(books).filter("class = 'series'").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("related").alias("m"))
    rows = {r["path"]: (r["n"], r["m"]) for r in got.collect()}
    assert len(rows) == 130 and all(n == 50 for n, _ in rows.values())
    assert rows["000"][1] == "050" and rows["129"][1] == "049"


def test_redundant_texts(spark):
    rows = [("/d", "甲_opt.pdf", 3), ("/D", "甲.txt", 3), ("/d", "乙.pdf", 1), ("/d", "乙（优化版）.txt", 2), ("/d", "丙.txt", 1), ("/d", "甲_【繁转简】.txt", 3)]
    df = spark.createDataFrame(rows, "dir string, name string, count long")
    got = {r["name"]: (r["hidden"], r["marked"]) for r in E.redundant_texts(df).collect()}
    assert got["甲.txt"] == (True, False) and got["乙（优化版）.txt"] == (False, True)
    assert got["丙.txt"] == (False, False) and got["甲_【繁转简】.txt"] == (False, False)
    assert E.hidden_files(df).count() == 1 and E.shown_files(df).count() == 5


def test_loose_siblings_guard(spark):
    few = [("/a", "文史 第10辑_OCR_opt.pdf"), ("/a", "文史 第10辑_10077398_PD6AIOCR.txt")]
    many = [("/b", f"gwyb{198000 + i}_FOCR_opt.txt") for i in range(7)] + [("/b", "gwyb.pdf")]
    files = spark.createDataFrame(few + many, "dir string, name string")
    got = {r["name"]: (r["peer"], r["how"]) for r in E.sibling(files, files.filter(F.endswith("name", F.lit(".txt")))).collect()}
    assert got["文史 第10辑_OCR_opt.pdf"] == ("文史 第10辑_10077398_PD6AIOCR.txt", "loose")
    assert got["gwyb.pdf"] == (None, None)


def test_text_helpers(spark):
    df = spark.createDataFrame([("０１２ＡＢ（x）", " a\u3000b ")], "w string, s string")
    r = df.select(
        X.half_width(F.col("w")).alias("w"), X.squeeze(F.col("s")).alias("s"), X.size_label(F.lit(1536)).alias("k"),
        X.size_label(F.lit(7)).alias("b"), X.safe_name(F.lit('a/b:c  "')).alias("n"), X.ext(F.lit("a.tar.GZ")).alias("e"),
        X.count_literal(F.lit("aaaa"), F.lit("aa")).alias("c"), X.is_cjk_name(F.lit("張a")).alias("no"), X.is_cjk_name(F.lit("張三丰")).alias("yes"),
    ).first()
    assert (r["w"], r["s"], r["k"], r["b"], r["e"], r["c"]) == ("012AB(x)", "a b", "1.5 KB", "7 B", ".gz", 2)
    assert r["n"] == "a_b_c" and not r["no"] and r["yes"]
