"""Prefix trie of conversations with totals over every subtree.

Conversations that begin with the same turns share the nodes of these turns.  A node is known
by its depth and two 64-bit hashes that combine, by exclusive or, the hashes of (place, turn)
of all turns up to it; so the keys of a conversation are prefix sums, and a conversation of
any length is worked on in chunks.

Totals over subtrees are rolled up by bands of ``BAND`` depths.  Within a band every node adds
its own values to its ancestors in that band only, so a node is copied ``BAND`` times at most.
The roots of the bands, with the totals of their bands, are a tree of a ``BAND``-th of the
depth: it is rolled up in the same way, and the completed totals of the roots are then handed
to the nodes of the band above them.  The rounds grow with the logarithm of the greatest
depth.  Every sum is combined before its shuffle, so the root of a hot first turn is no load.

Defined cases: turns are ordered by ``turn``, nulls first, ties and repeated rows by a digest of
role and text; null roles and texts are empty; rows without conv_id take no part; a rebuilt
conversation without turns is a member of the root alone; an empty table gives no rows; other
columns play no part.  Texts of any length are read as a whole and leave the scan as a digest
and a length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.functions.ranking import numbered
from bibliomill.llm.common import cut_lineage, group_edges, shuffle_width

BAND = 8
# The rebuilt conversations of the contract: up to five first turns of another one.
HEADS = 6
FAMILY = 100
# Turns of one conversation whose keys are summed by one group of a window.
CHUNK = 1024
# Conversation ids joined to one piece of text before they are hashed.
PIECE = 4096
KEY = ["depth", "k1", "k2"]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): numbered turns, from 1, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    narrow = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", named.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    placed = numbered(narrow, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("digest"), F.asc("chars")], "pos")
    return placed.select("conv_id", F.col("pos").cast("long").alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth, digest, chars, last) and all
    conversations (conv_id, length)."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    plan = sizes.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    kept = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = plan.join(of_base, "base", "left").select("conv_id", "base", "h", kept.alias("kept"), (kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    own = turns.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("kept") + F.col("pos") - F.col("h")).alias("depth"), "digest", "chars", "length")
    heads = turns.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    taken = heads.join(plan, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "chars", "length")
    both = own.unionByName(taken)
    return both.select("conv_id", "depth", "digest", "chars", (F.col("depth") == F.col("length")).alias("last")), plan.select("conv_id", "length")


def chains(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, chars, last): the nodes every conversation passes through, from
    the root (depth 0) on."""
    lanes = {"k1": F.xxhash64("depth", "digest"), "k2": F.xxhash64(F.lit("second lane"), "digest", "depth")}
    marked = turns.select("conv_id", "depth", "chars", "last", F.floor((F.col("depth") - 1) / CHUNK).alias("chunk"), *[c.alias(k) for k, c in lanes.items()])
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.select("conv_id", "depth", "chars", "last", "chunk", *[F.bit_xor(k).over(inside).alias(k) for k in lanes])
    chunks = marked.groupBy("conv_id", "chunk").agg(*[F.bit_xor(k).alias(k) for k in lanes])
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = chunks.select("conv_id", "chunk", *[F.bit_xor(k).over(before).alias(f"{k}_before") for k in lanes]).where("chunk > 0")
    whole = [F.col(k).bitwiseXOR(F.coalesce(f"{k}_before", F.lit(0))).alias(k) for k in lanes]
    nodes = summed.join(shift, ["conv_id", "chunk"], "left").select("conv_id", "depth", *whole, "chars", "last")
    zero = F.lit(0).cast("long")
    roots = conversations.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("chars"), (F.col("length") == 0).alias("last"))
    return nodes.unionByName(roots)


# ---- totals over subtrees ----------------------------------------------------------


def _handed_up(items: DataFrame, chain: DataFrame, first: Column, until: Column, step: int) -> DataFrame:
    """The values of every item at the nodes of its conversation from depth ``first`` to
    ``until``, ``step`` apart, summed by node."""
    copies = items.select("conv_id", F.explode(F.sequence(first, until, F.lit(step).cast("long"))).alias("depth"), "leaves", "saved")
    met = copies.join(chain.select("conv_id", *KEY), ["conv_id", "depth"])
    return met.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(items: DataFrame, chain: DataFrame, deepest: int, band: int = BAND, step: int = 1) -> DataFrame:
    """(depth, k1, k2, leaves, saved) over the subtree of every item.

    ``items(depth, k1, k2, conv_id, leaves, saved)`` are the nodes at the multiples of ``step``,
    ``conv_id`` any member and ``chain`` the nodes of the members.
    """
    high = step * band
    start = F.col("depth") - F.col("depth") % high
    named = items.select(*KEY, "conv_id")
    inside = _handed_up(items, chain, start, F.col("depth"), step)
    if deepest < high:
        return inside
    inside = cut_lineage(inside, "bands")
    roots = inside.where(F.col("depth") % high == 0).join(named, KEY)
    complete = subtree_totals(roots, chain, deepest, band, high).where("depth > 0").join(named, KEY)
    above = _handed_up(complete, chain, F.col("depth") - high, F.col("depth") - step, step)
    whole = inside.unionByName(above).groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return cut_lineage(whole, "totals")


# ---- digests of the members that end at a node ---------------------------------------


def _runs(batch: pd.DataFrame) -> Iterator[tuple[tuple[int, int, int], int, int]]:
    for lo, hi in group_edges(batch, KEY) if len(batch) else []:
        yield tuple(batch[KEY].iloc[lo]), lo, hi


def ending_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the rising, comma-joined conv_ids of each node.

    The ids of a node are joined to pieces where ranges of (node, id) lie, by as many tasks as
    they fill; one digest then runs over the pieces in order and holds none of them.
    """

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, lo, hi in _runs(batch):
                ids = batch["conv_id"].iloc[lo:hi].tolist()
                out += [(*key, ids[i], ",".join(map(str, ids[i : i + PIECE]))) for i in range(0, len(ids), PIECE)]
            yield pd.DataFrame(out, columns=[*KEY, "first", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for batch in batches:
            out = []
            for k, lo, hi in _runs(batch):
                if k != key:
                    if digest is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                    glue = b""
                for ids in batch["ids"].iloc[lo:hi]:
                    digest.update(glue + ids.encode())
                    glue = b","
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if digest is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*KEY, "ends_sha256"])

    width, schema = shuffle_width(ends.sparkSession), "depth long, k1 long, k2 long"
    order = [*KEY, "conv_id"]
    pieces = ends.repartitionByRange(width, *order).sortWithinPartitions(*order).mapInPandas(joined, f"{schema}, first long, ids string")
    return pieces.repartition(width, *KEY).sortWithinPartitions(*KEY, "first").mapInPandas(hashed, f"{schema}, ends_sha256 string")


def trie_report(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    turns, convs = rebuilt(cut_lineage(turn_digests(conversations), "turns"))
    chain = cut_lineage(chains(turns, convs), "chains")
    nodes = chain.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"))
    above = chain.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    nodes = cut_lineage(nodes.join(above, ["conv_id", "depth"], "left"), "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "children")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    own = nodes.select(*KEY, "conv_id", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    totals = subtree_totals(own, chain, deepest, band)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = ending_digests(chain.where("last").select(*KEY, "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(totals, KEY).join(parents, ["depth", "p1", "p2"], "left").join(ends, KEY, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    )


# The same in plain SQL: whole prefixes as lists, ancestors by the members' prefixes.
TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda d: [ascii(d)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
           lambda crc, bit: xor(xor(crc, bit) >> 1, 3988292384 * (xor(crc, bit) & 1)))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
seqs AS (
  SELECT c.conv_id, coalesce(s.seq, []) AS seq
  FROM c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, pos) AS seq FROM turns GROUP BY conv_id) s ON s.conv_id = c.conv_id),
chain AS (
  SELECT conv_id, depth, list_slice(seq, 1, depth) AS prefix, len(seq) = depth AS last, CASE WHEN depth = 0 THEN 0 ELSE length(seq[depth].text) END AS chars
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM seqs)),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM chain GROUP BY depth, prefix),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.prefix AS above
  FROM nodes n LEFT JOIN chain pc ON pc.conv_id = n.conv_id AND pc.depth = n.depth - 1
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = pc.prefix),
kids AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.depth = l.depth AND k.prefix = l.prefix),
totals AS (
  SELECT a.depth, a.prefix, sum((f.n_children = 0)::int) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens
  FROM full_nodes f JOIN chain a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY 1, 2)
SELECT f.conv_id::bigint AS conv_id, f.depth::bigint AS depth, f.parent_conv_id::bigint AS parent_conv_id, f.n_convs::bigint AS n_convs,
       f.n_children::bigint AS n_children, t.n_leaves::bigint AS n_leaves, t.saved_tokens::bigint AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN totals t ON t.depth = f.depth AND t.prefix = f.prefix
"""
