"""First-wins and numbering helpers that do not put a hot group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.session import cut_lineage


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``.  A minimum is combined on the map
    side, so a key holding a third of all rows costs no more than any other."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*[F.col(c) for c in [*order, *rest]])).alias("_best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [*order, *rest]])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, name: str = "rank") -> DataFrame:
    """At most ``k`` rows per key, numbered.  Spark cuts every task's share to ``k`` before
    the shuffle (window group limit), so hot keys stay small.  With None all rows stay, and
    without a number: an order of everything is no property of a row."""
    if k is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Row numbers within ``keys``, with the rows of a large key spread over many tasks.

    Rows are dealt out by ranges of (keys, order), so a key that holds any share of the
    table fills as many ranges as its size asks for.  They are written with the number of
    their range, numbered inside it, and shifted by the key's rows in the ranges before;
    only these counts meet in one task per key.  Rows that tie in ``order`` may fall into
    neighbouring ranges and still get different numbers.
    """
    taken = {c.lower() for c in df.columns}
    part, rows_of, before_of = (_free(taken, c) for c in ("_range", "_rows", "_before"))
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut_lineage(df.repartitionByRange(ranges, *keys, *order).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(rows_of))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, part])], F.coalesce(F.sum(rows_of).over(before), F.lit(0)).alias(before_of)
    )
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, part])]
    return dealt.withColumn(rows_of, F.row_number().over(inside)).join(shift, on).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col(before_of) + F.col(rows_of)).alias(name)
    )


def _free(taken: set[str], name: str) -> str:
    while name in taken:
        name = f"_{name}"
    return name
