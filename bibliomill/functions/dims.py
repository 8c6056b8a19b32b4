"""Small dimensions: size-checked reads and constant lookup arrays."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL = 512
# Terms looked for in a text one by one.  Up to here (measured: some 700 terms per page of
# 500 characters) that costs less than taking the page apart for a join.
TERMS = 512
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def small_rows(df: DataFrame, limit: int = SMALL) -> list[Row] | None:
    """The rows of a dimension when there are at most ``limit`` of them, else None.

    Callers that get None take their join plan, so no unbounded table ever reaches the
    driver.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the frame has at most so many rows and so many bytes, written as JSON.  Counts
    no further than one row beyond the limit."""
    bytes_of = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(bytes_of), F.lit(0))).first()
    return n <= rows and total <= size


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when rows and bytes are known to stay below their limits."""
    return F.broadcast(df) if is_small(df, limit) else df


def struct_array(rows: Sequence[Row], schema: T.StructType) -> Column:
    """A constant array of structs, used to look a small dimension up inside a row."""
    text = json.dumps([row.asDict(recursive=True) for row in rows], ensure_ascii=False)
    return F.from_json(F.lit(text), T.ArrayType(schema))
