"""Standing jobs: catalog refresh, progressive search, search history, excerpt intake."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bibliomill.operators import catalog as C
from bibliomill.operators import paging as P
from bibliomill.operators import search as S
from bibliomill.sources.publish import current, latest, publish

# Functions run by Python workers travel by value: no executor needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HISTORY_CAP = 30
NEVER = -(1 << 63) - 1
MAX_REFRESH_MINUTES = 1440
CATALOG = ["root", "dir", "name", "size", "mtime"]


def refresh_catalog(changes: DataFrame, base: str, checkpoint: str, minutes: int = 0) -> StreamingQuery:
    """Upsert streamed inventory rows into the catalog published at ``base``.

    Each micro-batch is compared with the current version and published as a new one, so a
    repeated batch changes nothing.  A stream of changes never proves that a file is gone:
    deletions are left to full snapshots.  ``minutes`` is the interval, 0 processes what
    is there and stops.
    """
    if not 0 <= minutes <= MAX_REFRESH_MINUTES:
        raise ValueError(f"minutes must be between 0 and {MAX_REFRESH_MINUTES}")
    columns = ["root", "dir", "name", "size", "mtime"]

    def upsert(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("dir", "name").agg(F.max(F.struct("mtime", "size", "root")).alias("_l"))
        new = latest.select("_l.root", "dir", "name", "_l.size", "_l.mtime")
        old = current(batch.sparkSession, base)
        if old is None:
            publish(new.select(*columns), base)
            return
        diff = C.snapshot_diff(old, new, scanned_roots=new.select("root").limit(0))
        publish(C.apply_diff(diff).select(*columns), base)

    writer = changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{minutes} minutes") if minutes else writer.trigger(availableNow=True)
    return writer.start()


def _upserts(batch: DataFrame) -> DataFrame:
    """The last state of each file in a batch."""
    latest = batch.groupBy("dir", "name").agg(F.max(F.struct("mtime", "size", "root")).alias("_l"))
    return latest.select("_l.root", "dir", "name", "_l.size", "_l.mtime")


def _changes_dir(base: str, version: str) -> str:
    return f"{base.rstrip('/')}/changes-{version}"


def refresh_changes(changes: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Keep the catalog published at ``base`` up to date by change rows.

    A micro-batch writes nothing but the last state of its own files, below the version that is
    current; :func:`catalog_now` reads them on top of that version, and :func:`compact_catalog`
    makes a new version of both.  A batch that runs again overwrites its own rows, or, after a
    compaction, adds rows that change nothing.
    """
    spark = changes.sparkSession
    if latest(spark, base) is None:
        publish(spark.createDataFrame([], changes.select(*CATALOG).schema), base)

    def append(batch: DataFrame, batch_id: int) -> None:
        version = latest(batch.sparkSession, base)["version"]
        _upserts(batch).withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{_changes_dir(base, version)}/part={batch_id}")

    writer = changes.select(*CATALOG).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def catalog_now(spark: SparkSession, base: str) -> DataFrame:
    """The catalog with the change rows since its version.

    Batches are taken in order: a file whose size is the same and whose time is less than a
    second away keeps the row it has.
    """
    entry = latest(spark, base)
    old = spark.read.parquet(entry["target"]).select(*CATALOG)
    try:
        new = spark.read.parquet(_changes_dir(base, entry["version"])).select(*CATALOG, "batch")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return old
    state = F.struct("root", "size", "mtime")
    steps = new.groupBy("dir", "name").agg(F.array_sort(F.collect_list(F.struct("batch", state.alias("state")))).alias("_steps"))
    held = old.select("dir", "name", state.alias("_state"))

    def step(now: Column, change: Column) -> Column:
        to = change["state"]
        close = F.abs(to["mtime"].cast("double") - now["mtime"].cast("double")) < 1
        return F.when((now["size"] == to["size"]) & close, now).otherwise(to)

    both = held.join(steps, ["dir", "name"], "full_outer")
    folded = F.aggregate(F.coalesce("_steps", F.array()), F.col("_state"), step)
    return both.withColumn("_now", folded).select("_now.root", "dir", "name", "_now.size", "_now.mtime")


def compact_catalog(spark: SparkSession, base: str) -> str:
    """Publish the catalog with its change rows as a new version, which has none."""
    return publish(catalog_now(spark, base), base)


def search_by_version(docs: DataFrame, terms: str, out: str, checkpoint: str) -> StreamingQuery:
    """Page hits of a document stream for the term table published at ``terms``, whose versions
    may change while the stream runs.

    Each micro-batch is matched as a batch with the version that is current when it starts, so
    there is no state and no join of streams, however many terms there are; its hits name the
    version and replace those of the same batch, should it run again.
    """

    def match(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry = latest(spark, terms)
        wanted = spark.read.parquet(entry["target"])
        hits = standing_search(batch, wanted).withColumn("terms_version", F.lit(entry["number"]).cast("long"))
        hits.write.mode("overwrite").parquet(f"{out.rstrip('/')}/part={batch_id}")

    return docs.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing_search(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Page hits of a document stream, in append mode: what arrives is cut into pages and
    matched as a batch would be, so all results together equal the batch result."""
    return S.page_hits(P.text_pages(S.documents_with_any(docs, terms)), terms)


class _History(StatefulProcessor):
    """Latest search per term of one user; emits the list after each batch.  The list is one
    value, read once and written once a batch, however many terms come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("list", "kw array<string>, at array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        held = self.seen.get()
        latest = dict(zip(held[0], held[1])) if held is not None else {}
        for batch in rows:
            # nanoseconds; a missing time is the smallest number
            for kw, at in zip(batch["kw"], batch["ts"].astype("datetime64[ns]").astype("int64").tolist()):
                if kw is not None and at > latest.get(kw, NEVER):
                    latest[kw] = at
        # Older terms can never return to the list by age alone: state stays at the cap.
        kept = sorted(latest.items(), key=lambda e: (-e[1], e[0]))[:HISTORY_CAP]
        self.seen.update(([k for k, _ in kept], [t for _, t in kept]))
        yield pd.DataFrame(
            {
                "user_id": [key[0]] * len(kept), "kw": [k for k, _ in kept], "ts": pd.to_datetime([t for _, t in kept]),
                "pos": range(1, len(kept) + 1),
            }
        )

    def close(self) -> None:
        pass


def history_stream(searches: DataFrame) -> DataFrame:
    """Search history per user as a stream (update mode): newest first, each term once, at
    most thirty.  Needs the RocksDB state store provider."""
    return searches.select("user_id", "kw", "ts").groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_History(),
        outputStructType="user_id long, kw string, ts timestamp, pos long",
        outputMode="Update",
        timeMode="None",
    )


def new_excerpts(records: DataFrame, delay: str = "60 days") -> DataFrame:
    """Excerpts not seen before within the delay, however often a notebook is read again."""
    keyed = records.withColumn("body_hash", F.sha2("body", 256))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ts", "src", "body_hash"])
