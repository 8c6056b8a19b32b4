"""Foreign catalogs: any table with a path-like and a name-like column becomes ``files``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliomill.functions import text as X

# Tables looked for, in this order, and the columns that qualify one.
TABLE_NAMES = ("items", "local_files", "files", "docs", "documents")
PATH_COLUMNS = ("filepath", "path")
NAME_COLUMNS = ("filename", "name", "title")
SIZE_COLUMNS = ("size",)
TIME_COLUMNS = ("mtime", "modify_time", "updated_at")


def _pick(df: DataFrame, names: tuple[str, ...]) -> str | None:
    have = {c.lower(): c for c in df.columns}
    return next((have[n] for n in names if n in have), None)


def find_foreign(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """The first known table that has both a path and a name column."""
    have = {name.lower(): df for name, df in tables.items()}
    for name in TABLE_NAMES:
        df = have.get(name)
        if df is not None and _pick(df, PATH_COLUMNS) and _pick(df, NAME_COLUMNS):
            return df
    return None


def adapt_foreign(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The foreign table in the common schema; missing sizes and times are 0."""
    df = find_foreign(tables)
    if df is None:
        raise ValueError("no table with a path and a name column")
    path, name = F.col(_pick(df, PATH_COLUMNS)), F.col(_pick(df, NAME_COLUMNS))
    size, time = _pick(df, SIZE_COLUMNS), _pick(df, TIME_COLUMNS)
    zero = F.lit(0)
    directory = F.coalesce(X.empty_to_null(X.dirname(path)), path)
    return df.select(
        name.alias("name"),
        directory.alias("dir"),
        X.ext(F.coalesce(X.empty_to_null(name), path)).alias("ext"),
        F.coalesce(F.col(size).cast("long") if size else zero, zero).cast("long").alias("size"),
        F.coalesce(F.col(time).cast("double") if time else zero, zero).cast("double").alias("mtime"),
        path.alias("path"),
    )
