"""Reign years, cycle names, telegram days."""

import pytest
from pyspark.sql import functions as F

from bibliomill.functions import calendar as K
from bibliomill.operators import mentions as M


def run(spark, texts, column):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r["v"] for r in df.coalesce(1).select(column(F.col("t")).alias("v")).collect()]


@pytest.fixture(scope="module")
def annotated(spark):
    return lambda t, **kw: run(spark, [t], lambda c: M.annotated(c, **kw))[0]


def test_numerals(spark):
    texts = ["二十四", "元", "正", "廿四", "卅", "100", "十", "一百〇五", "百", "千", "二4", "〇"]
    assert run(spark, texts, K.numeral_value) == [24, 1, 1, 24, 30, 100, 10, 105, 100, 1000, None, 0]
    df = spark.createDataFrame([(n,) for n in (1, 10, 15, 20, 24, 100, 105, 110, 333, 1000)], "n int")
    got = [r[0] for r in df.coalesce(1).select(K.era_year_text(F.col("n"))).collect()]
    assert got == ["元", "十", "十五", "二十", "二十四", "一百", "一百〇五", "一百十", "三百三十三", "1000"]


def test_cycle(spark):
    r = spark.range(1).select(
        K.ganzhi_of(F.lit(1840)), K.ganzhi_of(F.lit(1898)), K.ganzhi_index(F.lit("甲子")), K.ganzhi_index(F.lit("庚子")),
        K.ganzhi_index(F.lit("甲丑")), K.ganzhi_years(F.lit("甲子")), K.eras_text(F.lit(1898)),
    ).first()
    assert tuple(r)[:5] == ("庚子", "戊戌", 0, 36, None) and r[5] == [1744, 1804, 1864, 1924, 1984]
    assert "光绪二十四年" in r[6] and "明治三十一年" in r[6] and "同治" not in r[6]
    assert K.cycle_years(spark).filter("ganzhi = '甲子'").count() == 5
    assert K.eras(spark).filter("is_traditional").count() == 18


def test_annotation(annotated):
    a = annotated("光绪二十四年，戊戌变法。")
    assert "光绪二十四年【光绪二十四年=1898年】" in a and "戊戌【戊戌=1718年、1778年" not in a and "1898、" in a
    assert "1951" in annotated("民国四十年，迁台。")
    assert annotated("民国三十八年，改元。") == "民国三十八年，改元。"
    assert "1950" in annotated("民国三十九年")
    assert "民国二十六年=1937年】" in annotated("民国二十六年七七事变", allow_short_republic=True)
    assert "1912" in annotated("民国元年", allow_short_republic=True)
    over = annotated("康熙六十三年")
    assert "1724" in over and "存疑" in over and "雍正" in over
    assert "宣统" in annotated("光绪三十五年") and "1860" in annotated("咸丰庚申，英法联军入京。")
    assert "1662" in annotated("事在康熙元年前后。") and "1894" in annotated("甲午战争（1894年）")
    again = annotated("明治四十五年、大正十五年、昭和六十四年")
    assert all(y in again for y in ("1912", "1926", "1989"))


def test_annotating_twice_changes_nothing(annotated):
    for t in ("光绪二十四年", "光绪戊戌年与甲子年", "咸丰庚申，辛酉", "【光绪元年】外光绪元年"):
        once = annotated(t)
        assert annotated(once) == once


def test_note_list_and_mentions(spark):
    text = "光绪二十四年戊戌，光绪二十四年"
    noted = run(spark, [text], M.with_note_list)[0]
    assert noted.startswith(text + "\n【纪年换算】光绪二十四年=1898年；戊戌=") and noted.count("光绪二十四年=") == 1
    found = M.mentions(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("pos").collect()
    assert [(r["start"], r["end"], r["kind"]) for r in found] == [(0, 6, "era"), (6, 8, "gz"), (9, 15, "era")]
    assert all(text[r["start"] : r["end"]] == r["token"] for r in found)


def test_day_table_shape(spark):
    rows = M.day_table(K.rhyme_days(spark)).collect()
    assert len(rows) == 31
    per_tone = [sum(r[f"tone_{i}"] is not None for r in rows) for i in range(1, 6)]
    assert per_tone == [15, 15, 29, 30, 17]
    days = {r[0]: r for r in K.rhyme_day_rows()}
    assert [days[c][1] for c in "有艳东卅世引陷筱"] == [25, 29, 1, 30, 31, 31, 30, 17]
    assert days["有"][4] == "上声二十五有" and days["艳"][4] == "去声二十九艳" and "发" not in days
    chars = [c for row in K.RHYMES for c in row if c != "·"]
    assert len(chars) == len(set(chars))


def test_day_codes(spark):
    texts = ["昨日接有电，当即复去。", "艳电发表后，各方震动。", "有电文三件，已归档。", "此处没有电源。", "变电站今日送电。", "东电与艳电均已收到。", "通电全国。"]
    got = run(spark, texts, M.with_day_note)
    tails = ["有=25日", "艳=29日", None, None, None, "东=1日；艳=29日", None]
    for text, noted, tail in zip(texts, got, tails):
        assert noted == (text if tail is None else f"{text}\n【代日韵目：{tail}】")


def test_tasks_of_a_narrow_table_grow_in_number(spark, tmp_path, monkeypatch):
    from bibliomill.plans import registry

    rows = spark.range(50_000).selectExpr("id AS o_orderkey", "date'1995-01-01' AS o_orderdate", "uuid() AS o_comment")
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(registry, "TASK_BYTES", 1 << 16)
    finer = registry.Tables(spark, str(tmp_path)).orders
    assert finer.rdd.getNumPartitions() > 8
    assert sorted(r[0] for r in finer.select("o_orderkey").collect()) == list(range(50_000))
