"""Costly steps are done once: blocks, half width, state of a list, counts of a name."""

import datetime as dt
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from bibliomill.functions import text as X
from bibliomill.operators import aliases as A
from bibliomill.operators import biblio as B
from bibliomill.sources import files as L
from bibliomill.streaming import jobs as J


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_entities_are_counted_without_a_step_by_name(spark):
    hits = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("a", 2, 1), ("c", 2, 4), (None, 3, 1)], "term string, doc_id long, count long")
    lookup = spark.createDataFrame([("s", "a", "A"), ("s", "b", "A"), ("r", "a", "B"), ("s", None, "N")], "source string, term string, canon string")
    got = A.entity_counts(hits, lookup)
    assert len(re.findall(r"\bAggregate\b", plan(got))) == 2
    assert sorted(map(tuple, got.collect())) == [("A", 2, 6), ("B", 2, 3)]


def test_blocks_are_found_once(spark):
    rows = spark.createDataFrame([(1, "某某出版社"), (2, "x"), (None, "中华书局"), (None, "中华书局")], "doc_id long, block string")
    names = spark.createDataFrame([(1, "中华书局", "北京")], "pos long, publisher string, city string")
    got = B.publishers(rows.withColumn("mark", F.sha2("block", 256)), names)
    assert "sha2" not in plan(got)
    assert got.where("doc_id = 2").first()["publisher"] == "" and got.count() == 4


def test_a_text_is_brought_to_half_width_once_and_no_right_is_lost(spark, monkeypatch):
    texts = ["据商务印书馆授权重印", "經某某獨家授權出版", "版權所有：中华书局", "著作权 某人甲", "© 某某书局 (C) 甲乙", "ＩＳＢＮ 978-7-101-00000-1", "第 三 版 第2次印刷", "1999年 5月 出版者：某某社", "印刷发行 某某厂", "none", "", None]
    rows = spark.createDataFrame([(i, 0, "s", t) for i, t in enumerate(texts)], "doc_id long, source_rank int, source string, text string")
    got = B.rights(rows, ["doc_id"])
    assert plan(got).count("translate(") == 1
    found = sorted(got.collect())
    monkeypatch.setattr(B, "RIGHTS_LITERALS", {f: ("",) for f, _ in B.RIGHTS})
    assert found == sorted(B.rights(rows, ["doc_id"]).collect())
    assert all(any(r[f] is not None for r in found) for f, _ in B.RIGHTS)


def test_decoded_texts_are_handed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(L, "DECODED_BYTES", 10)
    data = ["abcdef", "吴佩孚", None, "x" * 30, "y"]
    batch = pa.array([d.encode("gb18030") if d is not None else None for d in data]), pa.array(["gb2312", "GBK", None, "gbk", "no-such"])
    pieces = [p.to_pylist() for p in L._decode_batch.func(iter([batch]))]
    assert sum(pieces, []) == data and len(pieces) > 1


class Value:
    def __init__(self):
        self.held, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = tuple(list(v) for v in value)


def test_the_history_of_a_user_is_read_and_written_once_a_batch():
    state, history = Value(), J._History()
    history.init(state)
    time = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    first = pd.DataFrame({"kw": [f"k{i % 40:02d}" for i in range(80)], "ts": [time(i) for i in range(80)]})
    (got,) = history.handleInputRows((7,), iter([first]), None)
    assert state.calls == ["get", "update"]
    assert list(got["kw"]) == [f"k{i:02d}" for i in range(39, 9, -1)] and list(got["pos"]) == list(range(1, 31))
    more = pd.DataFrame({"kw": ["k00", "k39", "new"], "ts": [pd.NaT, time(1), time(100)]})
    (got,) = history.handleInputRows((7,), iter([more]), None)
    assert list(got["kw"])[:2] == ["new", "k39"] and len(got) == 30 and got["ts"][1] == time(79)
    assert state.calls == ["get", "update"] * 2
