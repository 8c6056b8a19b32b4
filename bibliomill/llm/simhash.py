"""Near-duplicates by SimHash, compared exactly tile by tile.

A fingerprint bit is set when more than half of the XXH64 values (seed 42) of a text's
shingles have it.  Every pair of distinct fingerprints within the radius is found by numpy
exclusive-or and bit counts over tiles.  Fingerprints sit in cells by the population counts
of their four 16-bit lanes; two fingerprints that differ in r bits have lane counts that
differ by r in sum at most, so a cell meets only the few cells around it and all other tile
pairs are skipped.  A crowded cell is split into tiles of bounded size.

A tile pair reports a spanning forest of its links, not the links; the forests are joined to
components by exchanging smallest labels, round after round, in written tables.  Neither
links nor fingerprints pass the driver.

Defined cases: texts are compared by fingerprint, so repeated rows, null and empty texts
(fingerprint zero) are one class each; a text of fewer words than a shingle is one shingle; a
null id never names a component unless all its members are null; an empty table gives no
rows; other columns play no part.  Texts of any length are read as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliomill.llm.common import cut_lineage, free_name, group_edges, shuffle_width, whole_groups

SHINGLE = 3
RADIUS = 2
SEED = 42
# Fingerprints of a tile; a task holds two tiles and the comparison of some rows of one.
TILE = 2048
# Edges up to which components are found in one task.
FEW_EDGES = 50_000
ROWS_AT_ONCE = 128
LANES = 4


def simhash(text: str | None, words: int, join, digest) -> int:
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        hashes = [digest(join(parts), SEED)]
    else:
        hashes = [digest(join(s), SEED) for s in zip(*[parts[i:] for i in range(words)])]
    values = np.array(hashes, dtype=">u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        total += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(values)).tobytes(), "big", signed=True)


def fingerprint(text: Column, words: int = SHINGLE) -> Column:
    """Signed 64-bit fingerprint of a text column, computed in Arrow batches."""

    @F.pandas_udf(T.LongType())
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            yield pd.Series([simhash(t, words, b" ".join, xxh64_intdigest) for t in batch], dtype="int64")

    return hashed(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- tile pairs ------------------------------------------------------------------


def _lane(fp: Column, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 64 // LANES * i).bitwiseAND(F.lit((1 << 64 // LANES) - 1).cast("long"))).cast("int")


def _code(lanes: list[Column]) -> Column:
    out = lanes[0].cast("long")
    for lane in lanes[1:]:
        out = out * 64 + lane
    return out


def forward_steps(radius: int) -> list[tuple[int, ...]]:
    """Steps from a cell to itself and to those around it, one of each opposite pair."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(LANES):
        out = [(*s, d) for s in out for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [s for s in out if s >= (0,) * LANES]


def tile_rows(fingerprints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Rows (cell, home tile, guest tile, guest?, fp): every pair of fingerprints that may lie
    within the radius meets in one group of two tiles at least.

    A fingerprint is at home in its cell and a guest in its own and 20 neighbouring ones.  The
    table of cells has 17^4 rows at most.
    """
    lanes = [_lane(F.col("fp"), i) for i in range(LANES)]
    celled = fingerprints.select("fp", *[lane.alias(f"lane{i}") for i, lane in enumerate(lanes)])
    steps = F.array(*[F.array(*[F.lit(d) for d in s]) for s in forward_steps(radius)])
    at = [F.col(f"lane{i}") + F.element_at("step", i + 1) for i in range(LANES)]
    sizes = celled.groupBy(*[f"lane{i}" for i in range(LANES)]).agg(F.count(F.lit(1)).alias("n"))
    homes = sizes.select(_code([F.col(f"lane{i}") for i in range(LANES)]).alias("cell"), F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("home_tiles"))
    guests = (
        sizes.withColumn("step", F.explode(steps)).select(_code(at).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n"))
        .select("cell", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("guest_tiles"))
    )
    cells = cut_lineage(homes.join(guests, "cell"), "cells")
    mixed = F.xxhash64("fp")
    home = (
        celled.select("fp", _code([F.col(f"lane{i}") for i in range(LANES)]).alias("cell"))
        .join(F.broadcast(cells), "cell")
        .select("cell", F.pmod(mixed, F.col("home_tiles")).cast("int").alias("home"), F.explode(F.sequence(F.lit(0), F.col("guest_tiles") - 1)).alias("visit"), F.lit(False).alias("guest"), "fp")
    )
    guest = (
        celled.withColumn("step", F.explode(steps))
        .select("fp", _code(at).alias("cell"))
        .join(F.broadcast(cells), "cell")
        .select("cell", F.explode(F.sequence(F.lit(0), F.col("home_tiles") - 1)).alias("home"), F.pmod(mixed, F.col("guest_tiles")).cast("int").alias("visit"), F.lit(True).alias("guest"), "fp")
    )
    return home.unionByName(guest)


def forest(home: np.ndarray, guest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints with a link between the two tiles, and one of their component there."""
    nodes, where = np.unique(np.concatenate([home, guest]), return_inverse=True)
    h, g = where[: len(home)], where[len(home) :]
    label = np.arange(len(nodes))
    for at in range(0, len(home), ROWS_AT_ONCE):
        near = np.bitwise_count(home[at : at + ROWS_AT_ONCE, None] ^ guest[None, :]) <= radius
        near &= h[at : at + ROWS_AT_ONCE, None] != g[None, :]
        for r in np.flatnonzero(near.any(axis=1)):
            mine = np.append(label[g[near[r]]], label[h[at + r]])
            if mine.min() != mine.max():
                label[np.isin(label, mine)] = mine.min()
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


TILE_PAIR = ["cell", "home", "visit"]


def _compare(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Forests of all groups of a partition sorted by group."""
    none = np.empty(0, np.uint64)
    for rows in whole_groups(batches, TILE_PAIR):
        a, b = [none], [none]
        fp = rows["fp"].to_numpy().view(np.uint64)
        guest = rows["guest"].to_numpy()
        for lo, hi in group_edges(rows, TILE_PAIR):
            x, y = fp[lo:hi][~guest[lo:hi]], fp[lo:hi][guest[lo:hi]]
            if len(x) and len(y):
                u, v = forest(x, y, radius)
                a.append(u)
                b.append(v)
        yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def links(fingerprints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Forest edges (a, b) between distinct fingerprints, whose components are those of all
    pairs within the radius."""
    rows = tile_rows(fingerprints, radius, tile)
    dealt = rows.repartition(shuffle_width(rows.sparkSession), *TILE_PAIR).sortWithinPartitions(*TILE_PAIR)
    return dealt.mapInPandas(lambda batches: _compare(batches, radius), "a long, b long").distinct()


# ---- components ------------------------------------------------------------------


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``node`` and the smallest node it can reach (``root``), for the nodes of edges (a, b)
    that are not themselves the smallest.

    Alternates two steps on written tables: every node's larger neighbours, then its smaller
    ones, are hung on its smallest neighbour.  The number of rounds grows with the logarithm
    of the largest component; a round is a minimum per node, combined before the shuffle, and
    a join on the node whose other side is unique.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))

    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = cut_lineage(both, purpose)
    # a step makes no more than two pairs of one: few of them are not worth a shuffle
    few = current.count() <= FEW_EDGES
    before = None
    while True:
        # larger neighbours: the smallest label of the whole neighbourhood
        sides = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        sides = sides.coalesce(1) if few else sides
        low = lowest(sides)
        large = sides.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct(), purpose)
        # smaller neighbours: every edge points down, and a node keeps its smallest
        large = large.coalesce(1) if few else large
        low = lowest(large)
        joined = large.join(low, "u")
        small = joined.select("u", F.col("low").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("low").alias("v")))
        small = small.coalesce(1) if few else small
        after = cut_lineage(small.where("u <> v").distinct(), purpose)
        state = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        current, before = after, state


# ---- documents -------------------------------------------------------------------


def classes(hashed: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``fp``, ``root`` (a fingerprint that stands for the component) and ``component_id``: the smallest id of the fingerprints reachable, for the
    fingerprints of a written table (doc_id, fp)."""
    distinct = cut_lineage(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct.select("fp"), radius, tile))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document."""
    hashed = cut_lineage(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "hashed")
    return hashed.join(classes(hashed), "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest id, nulls last; among rows
    with that id, the smallest by content."""
    fp, row = free_name(docs, "fp"), free_name(docs, "row")
    marked = cut_lineage(docs.withColumn(fp, fingerprint(F.col("text"))).withColumn(row, F.monotonically_increasing_id()), "hashed")
    narrow = marked.select(F.col(fp).alias("fp"), F.col(row).alias("row"), "doc_id", F.xxhash64("text").alias("digest"))
    first = (
        narrow.join(classes(narrow), "fp")
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "row")).alias("best"))
        .select(F.col("best.row").alias(row))
    )
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return marked.join(first, row, "left_semi").select(*kept)
