"""Publishing a table: write aside, compare, then name the new version as current."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_versions"
SCHEMA = "number long, version string, rows long, published_at timestamp, target string"


class PublishError(RuntimeError):
    pass


def publish(df: DataFrame, base: str, expected_rows: int | None = None, partition_by: str | None = None, replica: str | None = None) -> str:
    """Write ``df`` as a new version below ``base`` and make it current.

    Readers follow the manifest, so they see the old version until the new one is written
    and its row count has been compared with what was sent to the writer (and with
    ``expected_rows``, where given); a version that fails is never named.  The plan runs
    once: the rows are counted while they are written.  A ``replica`` gets its own copy of
    the files, checked in the same way before either place names the version.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    number = (_last(spark, base) or 0) + 1
    seen = Observation(f"rows-{version}")
    path = f"{base.rstrip('/')}/v-{version}"
    _write(df.observe(seen, F.count(F.lit(1)).alias("n")), path, partition_by)
    expected = seen.get["n"] if expected_rows is None else expected_rows
    written = spark.read.schema(df.schema).parquet(path)
    rows = _checked(written, path, expected)
    places = {base: path}
    if replica:
        places[replica] = f"{replica.rstrip('/')}/v-{version}"
        _write(written, places[replica], partition_by)
        _checked(spark.read.schema(df.schema).parquet(places[replica]), places[replica], expected)
    for place, target in places.items():
        entry = spark.range(1).select(
            F.lit(number).cast("long").alias("number"), F.lit(version).alias("version"), F.lit(rows).cast("long").alias("rows"),
            F.current_timestamp().alias("published_at"), F.lit(target).alias("target"),
        )
        entry.coalesce(1).write.mode("append").parquet(f"{place.rstrip('/')}/{MANIFEST}")
    return version


def _write(df: DataFrame, path: str, partition_by: str | None) -> None:
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def _checked(written: DataFrame, path: str, expected: int) -> int:
    rows = written.count()
    if rows != expected:
        raise PublishError(f"{path} holds {rows} rows, expected {expected}; not published")
    return rows


def versions(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{base.rstrip('/')}/{MANIFEST}")


def latest(spark: SparkSession, base: str) -> Row | None:
    """The manifest's entry of the current version, None before the first publication."""
    try:
        return versions(spark, base).orderBy(F.desc("number"), F.desc("version")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _last(spark: SparkSession, base: str) -> int | None:
    row = latest(spark, base)
    return row["number"] if row else None


def current(spark: SparkSession, base: str) -> DataFrame | None:
    """The version with the highest number, None before the first publication."""
    row = latest(spark, base)
    return spark.read.parquet(row["target"]) if row else None
