"""Registered queries: a Spark plan over the given tables and, where plain SQL can say
the same, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Keys by which a table too small to fill the cores is spread over them.
KEYS = {
    "documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "orders": "o_orderkey",
    "events": "event_id",
}

# Of these few short columns are read; whatever their size, they are dealt out in tasks of so
# many bytes of the file.
NARROW = {"orders", "events"}
TASK_BYTES = 1 << 20

# Derived inputs, written once in SQL that Spark and the checking engine both accept.
VIEWS: dict[str, str] = {}


def spread(df: DataFrame, key: str | None, narrow: bool = False) -> DataFrame:
    """Hash-partition a scan of at most ``spark.sql.files.maxPartitionBytes`` by its key.

    Such a table is often one row group, which a single task reads however many splits the
    file is cut into.  What is dealt out here is bounded; a larger table is left as it is.
    A ``narrow`` table is dealt out at any size, and its tasks grow in number, not in length:
    splits would be as many as the cores.
    """
    if key is None:
        return df
    spark = df.sparkSession
    scanned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    one_split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if narrow:
        return df.repartition(max(spark.sparkContext.defaultParallelism, -(-scanned // TASK_BYTES)), key)
    if scanned > one_split:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, key)


class Tables:
    """The given tables and the derived inputs, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return spread(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), KEYS.get(name), name in NARROW)
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        used = {n: getattr(self, n) for n in _mentioned(text)}
        text = text.replace("{", "{{").replace("}", "}}")
        for n in used:
            text = text.replace("{{" + n + "}}", "{" + n + "}")
        return self.spark.sql(text, **used)


def _mentioned(text: str) -> list[str]:
    return [n for n in [*TABLES, *VIEWS] if "{" + n + "}" in text]


def oracle(select: str, **ctes: str) -> str:
    """SQL for the checking engine: the views it names (and their inputs) become CTEs."""
    order: list[str] = []
    bodies: dict[str, str] = {}

    def need(text: str) -> None:
        for n in _mentioned(text):
            if n in VIEWS and n not in bodies:
                need(VIEWS[n])
                bodies[n] = VIEWS[n]
                order.append(n)

    for body in ctes.values():
        need(body)
    need(select)
    parts = [(n, bodies[n]) for n in order] + list(ctes.items())
    names = {n: n for n in [*TABLES, *VIEWS]}
    head = ",\n".join(f"{n} AS ({_fill(b, names)})" for n, b in parts)
    return (f"WITH {head}\n" if parts else "") + _fill(select, names)


def _fill(text: str, names: dict[str, str]) -> str:
    for n in names:
        text = text.replace("{" + n + "}", n)
    return text


@dataclass
class Query:
    plan: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = Query(fn, sql)
        return fn

    return register
