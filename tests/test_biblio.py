"""Colophons, rights and the four-source record."""

from pyspark.sql import functions as F

from bibliomill.operators import biblio as B

SURNAMES = "李王张郑布邓"
PUBLISHERS = [("文物出版社", "北京", 1), ("商务印书馆", "北京", 2), ("台湾学生书局", "台北", 3), ("黄山书社", "合肥", 4)]


def dictionary(spark):
    return spark.createDataFrame(PUBLISHERS, "publisher string, city string, pos int")


CIP_TEXT = "图书在版编目（CIP）数据\n美的历程／李泽厚著．—北京：文物出版社，1981.3\nISBN 7-5010-0000-0\n定价：2.00元\n"
CIP_PDF = "图书在版编目（CIP）数据\n十五至十八世纪的物质文明／布罗代尔著．—北京：商务印书馆，1992.11\nISBN 7-100-01234-5\n定价：38.00元"


def test_deep_records_take_the_best_source(spark):
    one = "/库/李泽厚：美的历程（全1册）（北京 文物出版社1981年）"
    five = "/库/旧书名（北京 商务印书馆1992年）"
    files = [
        (one, "10342277_PD6AIFOCR.pdf"), ("/库", "续伪书通考_郑良树编著_台湾学生书局1984年.pdf"),
        ("/库", "美的历程_10502401_PD6AIFOCR.pdf"), ("/库", "美的历程_10502401_PD6AIFOCR_result.txt"),
        ("/库", "22222222_PD6AIFOCR.pdf"), (five, "十五至十八世纪的物质文明 第1卷_14296873_layered.pdf"),
    ]
    df = spark.createDataFrame(files, "dir string, name string")
    texts = spark.createDataFrame([("/库", "美的历程_10502401_PD6AIFOCR_result.txt", CIP_TEXT)], "dir string, name string, text string")
    pdfs = spark.createDataFrame([("/库", "22222222_PD6AIFOCR.pdf", CIP_PDF)], "dir string, name string, text string")
    d = dictionary(spark)

    def fields(t):
        keyed = t.withColumn("doc_id", F.xxhash64("dir", "name"))
        return B.colophon_fields(keyed, d, SURNAMES).join(keyed.select("doc_id", "dir", "name"), "doc_id")

    got = {(r["dir"], r["name"]): r for r in B.deep_records(df, fields(texts), fields(pdfs), d, SURNAMES).collect()}
    assert len(got) == len(files)
    a = got[files[0]]
    assert (a["author"], a["publisher"], a["year"], a["volume"], a["city"], a["publisher_src"]) == ("李泽厚", "文物出版社", "1981", "全1册", "北京", "folder")
    b = got[files[1]]
    assert (b["author"], b["publisher"], b["year"], b["city"], b["publisher_src"], b["city_src"]) == ("郑良树", "台湾学生书局", "1984", "台北", "file", "dict")
    c = got[files[2]]
    assert (c["publisher"], c["year"], c["city"], c["publisher_src"]) == ("文物出版社", "1981", "北京", "txt") and "李泽厚" in c["author"]
    e = got[files[4]]
    assert (e["publisher"], e["year"], e["city"], e["publisher_src"]) == ("商务印书馆", "1992", "北京", "pdf")
    f = got[files[5]]
    assert f["volume"] == "第1卷" and f["title_src"] == "file" and (f["publisher"], f["year"], f["publisher_src"]) == ("商务印书馆", "1992", "folder")


def test_responsible_parties(spark):
    cases = [
        ("王某某 张三丰编著\n出版社编", "张三丰编著"), ("中国社会科学院历史研究所、李一编", "中国社会科学院历史研究所 李一编"),
        ("本社编", ""), ("陌生人著", "陌生人著"), ("陌生人著 另有下文", ""), ("张三、李四着", "张三 李四著"), ("", ""),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t string")
    got = {r["t"]: r["a"] for r in df.select("t", B.authors_of(F.col("t"), SURNAMES).alias("a")).collect()}
    assert got == dict(cases)


def test_colophon_of_a_long_text_is_found_once(spark):
    filler = [f"正文第{i}行" for i in range(3000)]
    text = "\n".join(filler[:2500] + CIP_TEXT.splitlines() + filler[2500:])
    df = spark.createDataFrame([(1, text), (2, "无关键词\n" * 100), (3, "   ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in B.colophons(df).collect()}
    assert "李泽厚" in got[1]["block"] and got[1]["at_line"] == 2492
    assert got[2]["at_line"] is None and "…" in got[2]["block"] and 3 not in got


def test_rights(spark):
    colophon = "本书由中华书局授权出版发行\n版权所有：中华书局\nISBN 978-7-101-00000-1\n1998年3月第1版，1998年3月第1次印刷"
    rows = [(1, 0, "file", "癸巳类稿"), (1, 1, "folder", "某大学图书馆藏_授权影印"), (1, 9, "colophon", colophon), (2, 0, "file", "史记_中华书局授权影印本")]
    got = {r["id"]: r for r in B.rights(spark.createDataFrame(rows, "id int, source_rank int, source string, text string"), ["id"]).collect()}
    assert got[1]["isbn"].startswith("978") and got[1]["edition"] == "1" and got[1]["printing"] == "1" and got[1]["isbn_src"] == "colophon"
    assert got[1]["copyright_holder"] == "中华书局" and got[1]["pub_date"] == "1998年3月"
    assert got[2]["authorization"] and got[2]["authorization_src"] == "file"


def test_contents_page(spark):
    rows = [(1, 0, "序", 1), (1, 1, "正文", 5), (1, 2, "版权页", 9), (2, 0, "前言", 1), (2, 1, "版权", 3), (3, 0, "序", 1)]
    got = B.colophon_in_toc(spark.createDataFrame(rows, "doc_id int, pos int, title string, page long")).collect()
    assert {r["doc_id"]: r["page"] for r in got} == {1: 9, 2: 3, 3: 0}
