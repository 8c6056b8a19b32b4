"""Spellings, alias dictionaries and expansion."""

import random

from pyspark.sql import functions as F

from bibliomill.functions.variants import Variants
from bibliomill.operators import aliases as A

MAP = {"t2s": [("吳", "吴"), ("啟", "启")], "s2t": [("吴", "吳"), ("启", "啟")], "s2tw": [], "s2hk": [("启", "啓")]}
V = Variants(MAP)


def alias(spark, *lines):
    rows = [(s, r, i, l) for i, (s, r, l) in enumerate(lines)]
    return A.parse_alias_lines(spark.createDataFrame(rows, "source string, source_rank int, line_no long, line string"))


def names(df):
    return [r["value"] for r in df.orderBy("ord").collect()]


def terms(spark, *ts):
    return spark.createDataFrame([(t,) for t in ts], "term string")


def test_spellings_are_symmetric(spark):
    d = terms(spark, "吴佩孚", "吳佩孚", "梁启超", "同")
    got = {r["term"]: r for r in d.select("term", V.forms(F.col("term")).alias("f"), V.variants(F.col("term")).alias("v"), V.block_key(F.col("term")).alias("k")).collect()}
    assert got["吴佩孚"]["f"] == got["吳佩孚"]["f"] == ["吳佩孚", "吴佩孚"]
    assert got["吴佩孚"]["k"] == got["吳佩孚"]["k"] and got["同"]["v"] == []
    assert got["梁启超"]["v"] == ["梁啟超", "梁啓超"]


def test_phrases_give_the_same_closure_through_arrow(spark):
    by_phrase = Variants({**MAP, "s2tw": [("佩孚", "珮孚")]})
    assert not by_phrase.by_char
    got = terms(spark, "吴佩孚").select(by_phrase.variants(F.col("term")).alias("v")).first()["v"]
    assert set(got) == {"吳佩孚", "吴珮孚", "吳珮孚"}
    assert terms(spark, "吴佩孚").select(by_phrase.convert(F.col("term"), "s2tw").alias("c")).first()["c"] == "吴珮孚"


def test_both_spellings_of_a_name_give_one_set(spark):
    table = alias(spark, ("main", 0, "吴佩孚,子玉,吴玉帅"), ("main", 0, "吳佩孚,子玉,孚威将军"))
    for t in ("吴佩孚", "吳佩孚"):
        got = names(A.related(terms(spark, t), table, V))
        assert got[0] == t and len(got) == len(set(got))
        assert set(got) == {"吴佩孚", "吳佩孚", "子玉", "吴玉帅", "孚威将军"}
    off = terms(spark, "吴佩孚").withColumn("use_alias", F.lit(False)).withColumn("use_variant", F.lit(False))
    assert names(A.expand(off, table, V)) == ["吴佩孚"]


def test_supplement_replaces_a_mere_alias_and_adds_to_a_name(spark):
    table = alias(spark, ("main", 0, "温绍原,北平,壮勇"), ("main", 0, "康熙,玄烨"), ("place", 1, "北京,北平,燕京"), ("figure", 2, "康熙,清圣祖"))
    got = names(A.related(terms(spark, "北平"), table, V))
    assert got == ["北平", "北京", "燕京"]
    assert set(names(A.related(terms(spark, "康熙"), table, V))) == {"康熙", "玄烨", "清圣祖"}
    switched = A.enabled_sources(table, spark.createDataFrame([("place", False)], "source string, enabled boolean"))
    assert "壮勇" in names(A.related(terms(spark, "北平"), switched, V))


def test_blocked_names_hold_for_all_spellings(spark):
    table = alias(spark, ("main", 0, "吴佩孚,子玉,吴玉帅"))
    key = min("吴佩孚", "吳佩孚")
    blocked = spark.createDataFrame([(key, "子玉"), (key, "吴佩孚")], "block_key string, alias string")
    user = spark.createDataFrame([("吴佩孚", 1, "玉帅")], "word string, pos int, alias string")
    got = names(A.related(terms(spark, "吴佩孚"), table, V, user, blocked))
    assert got == ["吴佩孚", "吳佩孚", "玉帅", "吴玉帅"]
    assert "子玉" not in names(A.related(terms(spark, "吳佩孚"), table, V, user, blocked))


def test_people_lookup_add_import_remove(spark):
    base = alias(spark, ("main", 0, "吴佩孚,子玉,玉帅"), ("main", 0, "某人，子玉"))
    merged = A.merge_layers(base)
    assert {r["value"] for r in A.expand_all(terms(spark, "子玉"), merged).collect()} == {"吴佩孚", "玉帅", "某人"}
    assert A.canonical_all(terms(spark, "玉帅"), merged).first()["canon"] == "吴佩孚"
    assert A.expand_all(terms(spark, "不存在zz"), merged).count() == 0
    new = alias(spark, ("user", 3, "测试人物,甲一,乙二、丙三；丁四"))
    counts = A.import_counts(base, new).first()
    assert (counts["new_people"], counts["new_names"]) == (1, 4)
    both = A.replace_people(base, new)
    assert A.dictionary_counts(A.merge_layers(both)).first()["people"] == 3
    assert A.remove_people(both, new).filter("canon = '测试人物'").count() == 0


def test_homonyms_in_biographies_are_united(spark):
    main = spark.createDataFrame([(1, "张三", 1800), (2, "张三", 1900), (3, "", 1800)], "person_id int, name string, year int")
    alt = spark.createDataFrame([(1, 1, "字甲"), (2, 2, "字乙"), (2, 3, "ab字"), (1, 4, "张三"), (3, 5, "字丙")], "person_id int, seq int, alt_name string")
    got = {(r["canon"], r["alias"]) for r in A.people_from_biographies(main, alt).collect()}
    assert got == {("张三", "字甲"), ("张三", "字乙")}


def test_shadows_follow_their_source(spark):
    t = spark.createDataFrame([(1, 0, "吴玉帅"), (1, 1, "吳玉帅"), (1, 2, "启")], "query_id int, pos int, term string")
    seed = spark.createDataFrame([(1, "吴佩孚")], "query_id int, seed string")
    got = {(r["value"], r["source_term"]) for r in A.shadow_variants(t, seed, V).collect()}
    assert got == {("吳佩孚", "吴佩孚"), ("吳玉帅", "吴玉帅"), ("啟", "启"), ("啓", "启")}
    gone = {r["value"] for r in A.shadow_variants(t.filter("term <> '启'"), seed, V).collect()}
    assert "啟" not in gone


def test_first_names_of_hot_names_and_people(spark):
    """The cut before the join changes no row, however many people share a name."""
    rows = [(f"P{i:04d}", "shared", 0, i, 1) for i in range(1500)] + [("P0003", f"n{j:04d}", 0, 3, j + 2) for j in range(1200)]
    dice = random.Random(5)
    words = [f"w{i}" for i in range(14)]
    for i in range(160):
        rows.append((dice.choice(words), dice.choice(words), dice.randrange(3), 5000 + i, dice.randrange(4)))
    alias = spark.createDataFrame(rows, "canon string, alias string, source_rank int, line_no long, pos int")
    merged = A.merge_layers(alias)
    terms = ["shared", "P0003", "n0007", *words, "unknown"]
    asked = spark.createDataFrame([(t,) for t in terms + terms[:2]], "term string")
    kept = [tuple(r) for r in merged.select("canon", "alias", "source_rank", "line_no", "pos").collect()]
    for limit in (1, 4, 16):
        want = set()
        for term in terms:
            people = {c for c, a, *_ in kept if term in (c, a)}
            places = [((c, 0, 0, 0), c) for c in people] + [((c, r + 1, l, p), a) for c, a, r, l, p in kept if c in people]
            values = list(dict.fromkeys(v for _, v in sorted(places) if v != term))
            want |= {(term, v, i + 1) for i, v in enumerate(values[:limit])}
        got = [tuple(r) for r in A.expand_all(asked, merged, limit).select("term", "value", "ord").collect()]
        assert len(got) == len(want) and set(got) == want


def test_names_of_a_group_arise_after_the_last_shuffle(spark):
    lines = [("main", 0, f"head{i % 2},shared,name{i},head{(i + 1) % 2}") for i in range(12)]
    table = alias(spark, *lines, ("org", 1, "org,name1,shared,other"))
    asked = terms(spark, "shared", "head0", "name1", "name2", "none")
    grouped = A.group_aliases(asked, table, V)
    everyone = A.expand_all(asked, A.merge_layers(table))
    for df in (grouped, everyone):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert 0 <= plan.find("Generate posexplode") < plan.find("Exchange")
    got = {}
    for r in grouped.orderBy("term", "ord").collect():
        got.setdefault(r["term"], []).append((r["ord"], r["alias"]))
    evens = ["shared", *[x for i in range(0, 12, 2) for x in (f"name{i}", "head1")]]
    evens = list(dict.fromkeys(evens))
    # the supplement knows both as names of its own entity and replaces the main source
    assert got["shared"] == got["name1"] == [(1, "name1"), (2, "shared"), (3, "other")]
    assert got["head0"] == got["name2"] == list(enumerate(evens, 1))
    assert "none" not in got
    found = sorted((r["term"], r["value"]) for r in everyone.collect())
    people = {"head0": {0, 2, 4, 6, 8, 10}, "head1": {1, 3, 5, 7, 9, 11}}
    names_of = {h: {"shared", "head0", "head1", *[f"name{i}" for i in n]} for h, n in people.items()}
    names_of["org"] = {"org", "name1", "shared", "other"}
    want = sorted({(t, v) for t in ("shared", "head0", "name1", "name2") for h in names_of if t in names_of[h] for v in names_of[h] if v != t})
    assert found == want


def test_tiles_and_parts_of_a_group_keep_order_and_gaps(spark, monkeypatch):
    from bibliomill.operators import groups

    monkeypatch.setattr(groups, "TILE", 4)
    monkeypatch.setattr(groups, "TERMS", 2)
    lists = groups.name_lists(spark.createDataFrame([(b, f"{b}{i}" if i % 3 else f"x{i}", i) for b in "ab" for i in range(11)], "block string, value string, i int"), ["i"])
    members = spark.createDataFrame([(t, b) for t in ("p", "q", "r", "s", "t") for b in "ab"], "term string, block string")
    taken = [("q", "a1"), ("q", "b10"), ("r", "a4"), ("r", "a5"), ("s", "zz")]
    start = spark.createDataFrame([("p", 5)], "term string, start long")
    got = groups.names_of_terms(members, lists, spark.createDataFrame(taken, "term string, value string"), start)
    rows = sorted((r["term"], r["ord"], r["value"]) for r in got.collect())
    want = []
    for t in "pqrst":
        values = dict.fromkeys(f"{b}{i}" if i % 3 else f"x{i}" for b in "ab" for i in range(11))
        want += [(t, n, v) for n, v in enumerate([v for v in values if (t, v) not in taken], 6 if t == "p" else 1)]
    assert rows == want
