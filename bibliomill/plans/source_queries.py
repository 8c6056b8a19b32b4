"""Source, sink, notebook, redaction and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliomill.operators import notebook as B
from bibliomill.operators import redact as R
from bibliomill.operators import search as S
from bibliomill.plans.biblio_queries import strip
import bibliomill.plans.inputs  # noqa: F401  the derived inputs
from bibliomill.plans.registry import Tables, oracle, query
from bibliomill.plans.search_queries import BYWORD, VOCABULARY_SQL, hits1, hits_oracle, terms1, vocabulary
from bibliomill.session import shared_dir
from bibliomill.sources import files as L
from bibliomill.sources.publish import current, publish
from bibliomill.streaming import jobs as J


@query("src_02_decoded_texts", "SELECT doc_id, md5(text) AS digest FROM documents")
def _decoded(t: Tables) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    marked = F.concat(F.unhex(F.lit("EFBBBF")), raw)
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, marked).otherwise(raw).alias("content"))
    return d.select("doc_id", F.md5(L.decoded(F.col("content"))).alias("digest"))


@query(
    "src_03_decoded_with_hint",
    "SELECT doc_id, md5(text) AS digest FROM documents",
)
def _decoded_hint(t: Tables) -> DataFrame:
    # Plain ASCII reads the same in the hinted charset, which always goes first; an unknown
    # hint is passed over.
    ascii_only = F.length("text") == F.octet_length("text")
    hint = F.when(ascii_only & (F.col("doc_id") % 2 == 0), "GB2312").otherwise("no-such-charset")
    return t.documents.select("doc_id", F.md5(L.decoded(F.encode("text", "UTF-8"), hint)).alias("digest"))


PUBLISHER_ROWS = """
SELECT s_nationkey AS file_rank, s_suppkey AS line_no, CASE WHEN s_suppkey % 9 = 0 THEN '#' ELSE ' ' END || 'house ' || CAST(s_suppkey % 40 AS STRING) AS name,
  'city ' || CAST(s_suppkey AS STRING) || ' ' AS city FROM {supplier}"""


@query(
    "src_05_publisher_dimension",
    oracle(
        "SELECT trim(name) AS publisher, trim(arg_min(city, file_rank * 1000000 + line_no)) AS city FROM r WHERE NOT starts_with(name, '#') GROUP BY 1",
        r=PUBLISHER_ROWS,
    ),
)
def _publisher_dimension(t: Tables) -> DataFrame:
    return L.publisher_dimension(t.sql(PUBLISHER_ROWS)).select("publisher", "city")


@query(
    "src_10_snapshots",
    oracle("SELECT dir, name, mtime FROM {v_catalog} WHERE regexp_matches(lower(name), '\\.(png|jpg)$')").replace(
        "v_catalog WHERE", "(SELECT dir, mtime, regexp_replace(name, '\\.[^.]*$', CASE WHEN doc_id % 3 = 0 THEN '.PNG' ELSE '.txt' END) AS name FROM v_catalog) WHERE"
    ),
)
def _snapshot_files(t: Tables) -> DataFrame:
    shot = F.when(F.col("doc_id") % 3 == 0, ".PNG").otherwise(".txt")
    files = t.v_catalog.select("dir", "mtime", F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), shot).alias("name"))
    return L.snapshots(files).select("dir", "name", "mtime")


EXCERPTS = f"""
SELECT notebook, 0 AS block_no, '2026-01-01 00:00:' || CAST(10 + turn % 50 AS VARCHAR) AS ts,
  regexp_replace(array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: CASE WHEN {strip('l')} = '' THEN '' ELSE l END), chr(10)), '^\\n+', '') || chr(10) || chr(10) || '第二段' AS body,
  '—— 《书' || CAST(conv_id AS VARCHAR) || '》第3页' || chr(10) || '张三｜版本：PDF原本' AS cite, 'D:/库/' || CAST(conv_id AS VARCHAR) || '.pdf' AS src,
  CAST(turn + 1 AS VARCHAR) AS page, '引文｜全' AS cite_std, '' AS file_hint, CAST(conv_id AS VARCHAR) || '.pdf' AS fn, CAST(length(text) AS VARCHAR) AS size, '12' AS npages FROM {{v_notebook}}
UNION ALL
SELECT notebook, 1, 'old', '旧文' || CAST(turn AS VARCHAR), '《旧书' || CAST(conv_id % 7 AS VARCHAR) || '》第 ' || CAST(turn + 4 AS VARCHAR) || ' 頁' || CASE WHEN turn % 2 = 0 THEN '｜文件：某库/旧' || CAST(conv_id AS VARCHAR) || '.TXT' ELSE '' END,
  '', CAST(turn + 4 AS VARCHAR), '', CASE WHEN turn % 2 = 0 THEN '旧' || CAST(conv_id AS VARCHAR) || '.TXT' ELSE '旧书' || CAST(conv_id % 7 AS VARCHAR) END, '', '', '' FROM {{v_notebook}}"""


def excerpts(t: Tables) -> DataFrame:
    return B.parse_excerpts(t.v_notebook.select("notebook", "md"))


@query(
    "src_08_excerpts",
    oracle("SELECT notebook, CAST(block_no AS BIGINT) AS block_no, ts, body, cite, src, page, cite_std, file_hint, fn, size, npages FROM e", e=EXCERPTS),
)
def _excerpts(t: Tables) -> DataFrame:
    return excerpts(t).withColumn("block_no", F.col("block_no").cast("long"))


@query(
    "src_09_snapshot_records",
    oracle(
        """SELECT notebook, CASE WHEN turn % 2 = 0 THEN '2025-02-02 10:00' ELSE '2025-01-01' END AS ts, '书' || CAST(conv_id AS VARCHAR) || ' · 卷一' AS headline,
        '出处一｜出处二' AS detail, 'img/' || CAST(turn AS VARCHAR) || ' (1).png' AS img, '注' || CAST(conv_id AS VARCHAR) AS note, '正文甲' || chr(10) || '正文乙' || CAST(turn AS VARCHAR) AS text,
        'S' AS src, '3' AS page, 'f.pdf' AS fn FROM {v_snapshots}"""
    ),
)
def _snapshot_records(t: Tables) -> DataFrame:
    return B.parse_snapshots(t.v_snapshots.select("notebook", "md")).drop("block_no", "cite_std", "size", "npages")


NOTES = "SELECT doc_id, 'src=/a/' || source || ' |page=' || CAST(doc_id % 9 AS STRING) || '|fn=x=y.pdf| sz=' || CAST(n_chars AS STRING) || '|cite=' || lang || '|page=7' AS inner_note FROM {documents}"


@query(
    "bib_28_note_fields",
    oracle(
        "SELECT doc_id, '/a/' || source AS src, CAST(doc_id % 9 AS VARCHAR) AS page, 'x=y.pdf' AS fn, CAST(n_chars AS VARCHAR) AS size, '' AS npages, lang || '|page=7' AS cite FROM documents"
    ),
)
def _note_fields(t: Tables) -> DataFrame:
    n = t.sql(NOTES).withColumn("_n", B.note_fields(F.concat(F.lit("<!-- cv:"), "inner_note", F.lit(" -->"))))
    return n.select("doc_id", "_n.*")


@query(
    "bib_29_cited_hints",
    oracle(
        "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '旧' || CAST(conv_id AS VARCHAR) || '.TXT' ELSE '旧书' || CAST(conv_id % 7 AS VARCHAR) END AS file, CAST(turn + 4 AS VARCHAR) AS page FROM conversations"
    ),
)
def _cited_hints(t: Tables) -> DataFrame:
    c = t.conversations
    file = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("｜文件：某库/旧"), "conv_id", F.lit(".TXT"))).otherwise("")
    cite = F.concat(F.lit("《旧书"), (F.col("conv_id") % 7).cast("string"), F.lit("》第 "), (F.col("turn") + 4).cast("string"), F.lit(" 頁"), file)
    return c.select("conv_id", "turn", B.cited_hints(cite).alias("h")).select("conv_id", "turn", "h.*")


HIT_JSON = """
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN '{"file": "broken' ELSE
  '{"file": "f' || CAST(doc_id AS STRING) || '", "words": [{"word": " 甲 ", "pages": [3, 1, 3, 0, ' || CAST(n_chars AS STRING) || '], "count": 0}, {"word": "", "pages": [1]}, {"word": "乙", "pages": [2], "count": '
  || CAST(doc_id + 1 AS STRING) || '}, {"word": "丙", "pages": []}, {"word": "丁", "pages": [-1, 0]}]}' END AS json FROM {documents}"""


@query(
    "src_11_hit_lists_read",
    """
SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR) AS file, '甲' AS word, CASE WHEN n_chars IN (1, 3) THEN '1,3' WHEN n_chars = 2 THEN '1,2,3' ELSE '1,3,' || CAST(n_chars AS VARCHAR) END AS pages,
  CAST(CASE WHEN n_chars IN (1, 3) THEN 2 ELSE 3 END AS BIGINT) AS count FROM documents WHERE doc_id % 10 <> 9
UNION ALL SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR), '乙', '2', doc_id + 1 FROM documents WHERE doc_id % 10 <> 9""",
)
def _hit_lists_read(t: Tables) -> DataFrame:
    d = L.read_hit_lists(t.sql(HIT_JSON))
    return d.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


RESULT_ITEMS = """
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN '<file><name>cut' ELSE
  '<file isfolder="' || CASE WHEN doc_id % 4 = 1 THEN 'True' ELSE 'false' END || '"><name> n' || CAST(doc_id AS STRING) || '.pdf </name><path>D:/' || source
  || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END || '</path><type>pdf</type><modified>2024</modified>'
  || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '<sizebytes>' || CAST(n_chars AS STRING) || '</sizebytes>' END || '</file>' END AS item FROM {documents}"""


@query(
    "src_12_result_items",
    """
SELECT 'D:/' || source || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '/\\' END || 'n' || CAST(doc_id AS VARCHAR) || '.pdf' AS path, 'n' || CAST(doc_id AS VARCHAR) || '.pdf' AS name,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS size, CASE WHEN doc_id % 4 = 1 THEN '文件夹' ELSE 'pdf' END AS type, doc_id % 4 = 1 AS isfolder, '2024' AS modified
FROM documents WHERE doc_id % 10 <> 9""".replace("'/\\' END", "'\\' END"),
)
def _result_items(t: Tables) -> DataFrame:
    return L.parse_results(t.sql(RESULT_ITEMS), include_folders=True)


@query("snk_01_published_catalog", oracle("SELECT root, dir, name, size, mtime FROM {v_catalog}"))
def _published(t: Tables) -> DataFrame:
    base = shared_dir(t.spark, "catalog")
    publish(t.v_old.select("root", "dir", "name", "size", "mtime"), base, partition_by="root")
    replica = shared_dir(t.spark, "replica")
    publish(t.v_catalog.select("root", "dir", "name", "size", "mtime"), base, partition_by="root", replica=replica)
    # the replica's own files are read
    return current(t.spark, replica).select("root", "dir", "name", "size", "mtime")


@query(
    "snk_03_hit_lists_written",
    hits_oracle(
        """SELECT doc_id, '{"file":"' || CAST(doc_id AS VARCHAR) || '","words":[' || string_agg('{"word":"' || word || '","pages":[' || pages || '],"count":' || CAST(count AS VARCHAR) || '}', ',' ORDER BY rank) || ']}' AS json FROM w GROUP BY doc_id""",
        w=BYWORD,
    ),
)
def _hit_lists_written(t: Tables) -> DataFrame:
    return L.hit_lists(S.hits_by_word(hits1(t)))


@query(
    "snk_04_notebook_round_trip",
    oracle("SELECT notebook, CAST(block_no AS BIGINT) AS block_no, ts, body, cite, src, page, cite_std, fn, size, npages FROM e", e=EXCERPTS),
)
def _round_trip(t: Tables) -> DataFrame:
    again = B.parse_excerpts(B.notebook_markdown(excerpts(t)))
    return again.withColumn("block_no", F.col("block_no").cast("long")).drop("file_hint")


REDACTION = [(1, "the the", "<pair>"), (2, "the", "<t>"), (3, "<t> ", "_"), (4, "der", "xx"), (5, "que", "")]
KEEP = ["there", "thede"]


def redaction_sql() -> str:
    s = "text"
    for i, k in enumerate(KEEP):
        s = f"replace({s}, '{k}', chr(1) || '{i}' || chr(1))"
    for _, old, new in REDACTION:
        s = f"replace({s}, '{old}', '{new}')"
    for i, k in enumerate(KEEP):
        s = f"replace({s}, chr(1) || '{i}' || chr(1), '{k}')"
    return s


@query("red_01_redacted", f"SELECT doc_id, md5({redaction_sql()}) AS digest FROM documents")
def _redacted(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame(REDACTION, "rank int, old string, new string")
    return R.redact(t.documents.select("doc_id", "text"), rules, KEEP).select("doc_id", F.md5("text").alias("digest"))


@query(
    "red_01_leaks",
    "SELECT doc_id, CASE WHEN contains(text, 'eaux') THEN 'eaux' WHEN contains(text, 'tion') THEN 'tion' ELSE 'sch' END AS word FROM documents "
    "WHERE contains(text, 'eaux') OR contains(text, 'tion') OR contains(text, 'sch')",
)
def _leaks(t: Tables) -> DataFrame:
    words = t.spark.createDataFrame([(1, "eaux"), (2, "tion"), (3, "sch")], "rank int, word string")
    return R.leaks(t.documents, words)


# ---- streams ---------------------------------------------------------------------------


def stream(t: Tables, table: str) -> DataFrame:
    schema = getattr(t, table).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{table}*.parquet")


@query(
    "str_01_streamed_refresh",
    oracle(
        """SELECT coalesce(n.dir, o.dir) AS dir, coalesce(n.name, o.name) AS name,
        CASE WHEN n.name IS NULL OR (o.size = n.size AND abs(o.mtime - n.mtime) < 1) THEN o.size ELSE n.size END AS size
        FROM {v_old} o FULL JOIN {v_new} n ON o.dir = n.dir AND o.name = n.name"""
    ),
)
def _streamed_refresh(t: Tables) -> DataFrame:
    columns = ["root", "dir", "name", "size", "mtime"]
    base, inbox = shared_dir(t.spark, "catalog"), shared_dir(t.spark, "inbox")
    publish(t.v_old.select(*columns), base)
    t.v_new.select(*columns).repartition(3, "dir", "name").write.parquet(inbox)
    changes = t.spark.readStream.schema(t.v_new.select(*columns).schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    J.refresh_catalog(changes, base, shared_dir(t.spark, "offsets")).awaitTermination()
    return current(t.spark, base).select("dir", "name", "size")


@query(
    "str_01_change_rows",
    oracle(
        """SELECT coalesce(n.dir, o.dir) AS dir, coalesce(n.name, o.name) AS name,
        CASE WHEN n.name IS NULL OR (o.size = n.size AND abs(o.mtime - n.mtime) < 1) THEN o.size ELSE n.size END AS size
        FROM {v_old} o FULL JOIN {v_new} n ON o.dir = n.dir AND o.name = n.name"""
    ),
)
def _change_rows(t: Tables) -> DataFrame:
    base, inbox = shared_dir(t.spark, "catalog"), shared_dir(t.spark, "inbox")
    publish(t.v_old.select(*J.CATALOG), base)
    offsets = shared_dir(t.spark, "offsets")
    # a compaction between the runs of one stream
    for part in range(2):
        t.v_new.select(*J.CATALOG).where(F.pmod(F.xxhash64("dir", "name"), F.lit(2)) == part).repartition(2, "dir", "name").write.mode("append").parquet(inbox)
        changes = t.spark.readStream.schema(t.v_new.select(*J.CATALOG).schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        J.refresh_changes(changes, base, offsets).awaitTermination()
        if part == 0:
            J.compact_catalog(t.spark, base)
    return J.catalog_now(t.spark, base).select("dir", "name", "size")


@query(
    "str_02_large_vocabulary",
    VOCABULARY_SQL,
)
def _large_vocabulary_stream(t: Tables) -> DataFrame:
    found = J.standing_search(stream(t, "documents"), vocabulary(t)).select("doc_id", "term")
    out = shared_dir(t.spark, "hits")
    q = found.writeStream.format("parquet").option("checkpointLocation", shared_dir(t.spark, "offsets"))
    q.trigger(availableNow=True).start(out).awaitTermination()
    by_doc = t.spark.read.schema(found.schema).parquet(out).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("term").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("docs"))


@query(
    "str_02_changing_terms",
    hits_oracle(
        "SELECT doc_id, CAST(page AS BIGINT) AS page, term, n AS count, CAST(1 + doc_id % 2 AS BIGINT) AS terms_version FROM h1 WHERE pos % 2 = 1 OR doc_id % 2 = 1"
    ),
)
def _changing_terms(t: Tables) -> DataFrame:
    terms, inbox, out = (shared_dir(t.spark, p) for p in ("terms", "inbox", "hits"))
    offsets = shared_dir(t.spark, "offsets")
    # the first version knows every other term; documents of odd id come after the second
    for part, known in enumerate(["pos % 2 = 1", "true"]):
        publish(terms1(t).where(known), terms)
        t.documents.where(F.pmod("doc_id", F.lit(2)) == part).write.mode("append").parquet(inbox)
        docs = t.spark.readStream.schema(t.documents.schema).parquet(inbox)
        J.search_by_version(docs, terms, out, offsets).awaitTermination()
    return t.spark.read.parquet(out).select("doc_id", "page", "term", "count", "terms_version")


FOLDERS = ["a", "a/b", "a/.git/x", "B/$RECYCLE.BIN", "c d/ü/e", "a/node_modules"]


# Folder and name of the file of a document.
PLACE = [
    f"element_at(array({', '.join(repr(f) for f in FOLDERS)}), CAST(1 + doc_id % {len(FOLDERS)} AS INT)) AS dir",
    "'n ä' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' WHEN 3 THEN '.exe' ELSE '' END AS name",
]


@query(
    "src_01_inventory",
    "SELECT dir, name, regexp_replace(name, '\\.[^.]*$', '') AS stem, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext, strlen(coalesce(text, ''))::bigint AS size "
    + f"FROM (SELECT {PLACE[0].replace('element_at(array(', 'list_extract(list_value(')}, {PLACE[1]}, text FROM documents) "
    + "WHERE dir IN ('a', 'a/b', 'c d/ü/e') AND regexp_matches(lower(name), '[.](pdf|txt)$')",
)
def _inventory(t: Tables) -> DataFrame:
    root = shared_dir(t.spark, "tree")
    top = L._mounted(root)

    def put(batches):
        import os

        import pandas as pd

        for batch in batches:
            for folder, name, text in zip(batch["dir"], batch["name"], batch["text"]):
                os.makedirs(f"{top}/{folder}", exist_ok=True)
                with open(f"{top}/{folder}/{name}", "wb") as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    t.documents.selectExpr(*PLACE, "text").mapInPandas(put, "n long").agg(F.sum("n")).collect()
    files = L.inventory(t.spark, [root, f"{root}-absent"])
    return files.select(F.substring("dir", len(top) + 2, 10_000).alias("dir"), "name", "stem", "ext", "size")


@query(
    "str_02_progressive_search",
    hits_oracle("SELECT doc_id, CAST(page AS BIGINT) AS page, term, n AS count FROM h1"),
)
def _progressive(t: Tables) -> DataFrame:
    found = J.standing_search(stream(t, "documents"), terms1(t)).select("doc_id", "page", "term", "count")
    out = shared_dir(t.spark, "hits")
    q = found.writeStream.format("parquet").option("checkpointLocation", shared_dir(t.spark, "offsets"))
    q.trigger(availableNow=True).start(out).awaitTermination()
    return t.spark.read.schema(found.schema).parquet(out)


@query(
    "str_03_history_stream",
    """
SELECT user_id, kw, CAST(pos AS BIGINT) AS pos FROM (
  SELECT user_id, kw, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, kw) AS pos FROM (
    SELECT user_id, event_type || '-' || CAST(event_id % 50 AS VARCHAR) AS kw, max(ts) AS ts FROM events GROUP BY 1, 2)) WHERE pos <= 30""",
)
def _history_stream(t: Tables) -> DataFrame:
    t.spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    kw = F.concat_ws("-", "event_type", (F.col("event_id") % 50).cast("string"))
    searches = stream(t, "events").select("user_id", kw.alias("kw"), F.col("ts").cast("timestamp").alias("ts"))
    out = shared_dir(t.spark, "history")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = J.history_stream(searches).writeStream.outputMode("update").foreachBatch(keep)
    q.option("checkpointLocation", shared_dir(t.spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(out)
    last = rows.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["user_id", "batch"]).select("user_id", "kw", "pos")


@query(
    "str_04_excerpt_intake",
    "SELECT DISTINCT src, body FROM (SELECT 'conv ' || CAST(conv_id AS VARCHAR) AS src, text AS body, turn FROM conversations)",
)
def _excerpt_intake(t: Tables) -> DataFrame:
    turns = stream(t, "conversations")
    ts = F.timestamp_seconds(F.lit(1_700_000_000))
    records = turns.select(ts.alias("ts"), F.concat(F.lit("conv "), "conv_id").alias("src"), F.col("text").alias("body"))
    new = J.new_excerpts(records.unionByName(records)).select("src", "body")
    out = shared_dir(t.spark, "excerpts")
    q = new.writeStream.format("parquet").option("checkpointLocation", shared_dir(t.spark, "offsets"))
    q.trigger(availableNow=True).start(out).awaitTermination()
    return t.spark.read.schema(new.schema).parquet(out)
