"""What several operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliomill.session import cut_lineage

# Words of the contracts: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """A value kept in a Python worker from task to task, such as a loaded vocabulary.

    Only the last key is kept, so the caches of several operators never add up.
    """
    kept = sys.__dict__.setdefault("_bibliomill_llm_state", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the frame, already written or small, has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of a partition sorted by ``keys``, in frames that hold whole groups only; a
    group may span batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and (batch[keys].iloc[-1] == held[-1][keys].iloc[-1]).all():
            held.append(batch)
            continue
        rows = pd.concat([*held, batch], ignore_index=True)
        other = np.flatnonzero((rows[keys].to_numpy() != rows[keys].iloc[-1].to_numpy()).any(axis=1))
        start = int(other[-1]) + 1 if len(other) else 0
        if start:
            yield rows.iloc[:start]
        held = [rows.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def group_edges(rows: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """Start and end of each group in rows sorted by numeric ``keys``."""
    values = rows[keys].to_numpy()
    edges = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
    return list(zip([0, *edges], [*edges, len(rows)]))


__all__ = ["WORD", "broadcast_up_to", "cut_lineage", "free_name", "group_edges", "shuffle_width", "table", "whole_groups", "worker_state"]
