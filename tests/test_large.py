"""Large vocabularies, changing term tables, change rows and listings on executors."""

import os
import random

from pyspark.sql import functions as F

from bibliomill.functions import automaton
from bibliomill.operators import relocate as R
from bibliomill.operators import search as S
from bibliomill.sources import files as L
from bibliomill.sources.publish import current, publish, versions
from bibliomill.streaming import jobs as J

PAGES = "doc_id long, ord int, page long, text string"


def counted(pages, words):
    return sorted((d, w, t.count(w)) for d, _, _, t in pages for w in set(words) if t and w and w in t)


def test_automaton_counts_what_plain_search_counts(spark, monkeypatch):
    rng = random.Random(4)
    pages = [(i, 0, 1, "".join(rng.choice("ab 吴佩😀\n") for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(99, 0, 1, None), (100, 0, 1, "aaaaa")]
    words = ["a", "aa", "aaa", "ab", "ba", "吴", "吴佩", "佩吴", "😀", "b😀", " ", "never", ""]
    terms = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, pos int")
    frame = spark.createDataFrame(pages, PAGES)
    for limit in (100, 1):
        got = S.page_hits(frame, terms, limit=limit).select("doc_id", "term", "count").collect()
        assert sorted(map(tuple, got)) == counted(pages, words)
    monkeypatch.setattr(automaton, "SHARD_TERMS", 3)
    got = S.page_hits(frame, terms, limit=1).select("doc_id", "term", "count").collect()
    assert sorted(map(tuple, got)) == counted(pages, words)
    spots = frame.select("doc_id", F.explode(automaton.found_terms(F.col("text"), ["aa", "吴佩"])).alias("f")).select("doc_id", "f.*")
    texts = {d: t for d, _, _, t in pages}
    assert all(texts[r["doc_id"]].find(r["term"]) == r["first"] for r in spots.collect())
    repeated = terms.unionByName(terms)
    assert S.page_hits(frame, repeated, limit=1).count() == 2 * len(counted(pages, words))


def test_a_large_vocabulary_is_one_scan_without_a_shuffle_of_texts(spark):
    terms = spark.range(2_000).select(F.concat(F.lit("w"), "id").alias("term"), F.lit(0).alias("pos"))
    pages = spark.createDataFrame([(1, 0, 1, "w17 w1999")], PAGES)
    hits = S.page_hits(pages, terms)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
    assert sorted(r["term"] for r in hits.collect()) == ["w1", "w17", "w19", "w199", "w1999"]


def test_a_standing_search_keeps_no_state(spark, tmp_path):
    terms = spark.range(2_000).select(F.concat(F.lit("w"), "id").alias("term"), F.lit(0).alias("pos"))
    spark.createDataFrame([(1, "w17 w5"), (2, "none")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    query = J.standing_search(docs, terms).writeStream.format("parquet").option("checkpointLocation", offsets).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert not query.lastProgress["stateOperators"] and not os.path.exists(f"{offsets}/state")
    assert sorted(r["term"] for r in spark.read.parquet(out).collect()) == ["w1", "w17", "w5"]


FILES = "root string, dir string, name string, size long, mtime timestamp"


def files(spark, *rows):
    frame = spark.createDataFrame([("r", "d", n, s, m) for n, s, m in rows], "root string, dir string, name string, size long, m double")
    return frame.withColumn("mtime", F.timestamp_seconds("m")).drop("m")


def state(spark, base):
    return sorted((r["name"], r["size"], r["m"]) for r in J.catalog_now(spark, base).withColumn("m", F.col("mtime").cast("double")).collect())


def test_change_rows_are_as_large_as_their_batches(spark, tmp_path):
    base, inbox, offsets = (str(tmp_path / p) for p in ("catalog", "inbox", "offsets"))
    publish(files(spark, *[(f"f{i}", 1, 100.0) for i in range(500)]), base)

    def run():
        J.refresh_changes(spark.readStream.schema(FILES).parquet(inbox), base, offsets).awaitTermination()

    files(spark, ("f1", 1, 100.4), ("f2", 2, 100.0), ("new", 5, 1.0), ("new", 6, 2.0)).write.parquet(inbox)
    run()
    version = versions(spark, base).first()["version"]
    assert spark.read.parquet(f"{base}/changes-{version}").count() == 3
    now = state(spark, base)
    assert len(now) == 501 and ("f1", 1, 100.0) in now and ("f2", 2, 100.0) in now and ("new", 6, 2.0) in now
    J.compact_catalog(spark, base)
    assert state(spark, base) == now and current(spark, base).count() == 501
    # the same rows once more, as by a batch that runs again after the compaction
    files(spark, ("f1", 1, 100.4), ("f2", 2, 100.0), ("new", 6, 2.0)).write.mode("append").parquet(inbox)
    run()
    assert state(spark, base) == now
    files(spark, ("f2", 3, 100.0)).write.mode("append").parquet(inbox)
    run()
    assert ("f2", 3, 100.0) in state(spark, base) and len(state(spark, base)) == 501


def test_folders_are_walked_by_tasks_and_pruned_before_descent(spark, tmp_path):
    for place in ("a/x.PDF", "a/.git/y.pdf", "a/b/c/z.txt", "Node_Modules/q.pdf", "a/no.exe", "a/.hidden/b/t.txt"):
        path = tmp_path / place
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    os.symlink(tmp_path / "a", tmp_path / "a" / "b" / "loop")
    got = L.inventory(spark, [str(tmp_path), f"file://{tmp_path}/a/b", str(tmp_path / "absent")])
    rows = sorted((r["root"].removeprefix("file://").removeprefix(str(tmp_path)), r["dir"].removeprefix(str(tmp_path)), r["name"], r["size"]) for r in got.collect())
    assert rows == [("", "/a", "x.PDF", 5), ("", "/a/b/c", "z.txt", 5), ("/a/b", "/a/b/c", "z.txt", 5)]
    listed = {r["path"] for r in L.walked(spark, [str(tmp_path)]).select("path").collect()}
    assert not any(".git" in p or "Node_Modules" in p for p in listed)


def test_titles_find_the_first_name_that_begins_with_them(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab吴") for _ in range(rng.randrange(0, 7)))
    titles, names = [word() for _ in range(60)] + ["ab", "ab"], [(word(), f"{rng.randrange(500):03d}") for _ in range(300)]
    titles = [x for x in titles if x]
    got = R.first_beginning_with(spark.createDataFrame([(x,) for x in titles], "title string"), spark.createDataFrame(names, "name string, found string"))
    want = {t: min((f for n, f in names if n.startswith(t)), default=None) for t in set(titles)}
    assert {r["title"]: r["found"] for r in got.collect()} == {t: f for t, f in want.items() if f is not None}
    nothing = spark.createDataFrame([], "name string, found string")
    assert R.first_beginning_with(spark.createDataFrame([("a",)], "title string"), nothing).collect() == []
