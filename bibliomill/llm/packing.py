"""Packing documents into sequences of a fixed number of tokens.

Texts are cut into tokens of a public vocabulary; a closing token ends each document; only
documents longer than a sequence are cut.  Pieces are then placed by the sum-of-squares
rule: with N(g) open sequences that have g tokens left, a piece goes where the sum of N(g)^2
becomes smallest.  The rule avoids piling up sequences with one and the same gap that
nothing may ever fill.  Longest pieces come first, and a sequence is opened only when no
open one has room, which leaves fewer sequences than opening one by the rule.

Pieces, not texts, are dealt to groups of bounded size; what a group could not fill is
taken apart and packed again with that of other groups until the open rest fits one group.

Defined cases: a null or empty text is its closing token alone; repeated rows are packed
each for itself; ties between equally good gaps go to the smallest gap; an empty table
gives no rows; other columns play no part.  A text of any length is tokenised as a whole.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliomill.llm.common import cut_lineage, worker_state

CAPACITY = 2048
CLOSING_ID = 0
# Pieces packed together in one task, and the fill below which a group's sequences are
# taken apart for the next round.
GROUP = 20_000
ENOUGH = 0.995
CACHE_CHUNKS = 400_000

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Chunks:
    """Token ids (little-endian 32-bit) of texts, by chunks that start at a blank.

    A blank after a character that is no white space always starts a new pre-token of the
    byte-level pattern, and so does what follows the letters of a word; the ids of a text are
    those of these parts in a row.  Parts recur, and each is encoded once.  The ranks file
    holds the same vocabulary as the ``tokenizers`` file of the same name and gives the same
    ids in a fifth of the time.  The added tokens of the latter file are found in a text before
    anything else, as there, and the parts between them are encoded each for itself.
    """

    FAR = re.compile(r"\s ")
    BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")
    LETTERS = re.compile(r"[^\W\d_]*")

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
        self.at_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.limit = limit
        self.known: dict[str, bytes] = {}  # by the chunk without its leading blank
        self.words: dict[str, bytes] = {}  # of letters, with a blank before
        self.tails: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def kept(self, where: dict[str, bytes], key: str, made: bytes) -> bytes:
        if len(where) >= self.limit:
            where.clear()
        if len(key) <= 64:
            where[key] = made
        return made

    def chunk(self, chunk: str) -> bytes:
        """A blank and the chunk."""
        word = self.LETTERS.match(chunk)[0]
        if not word.isalpha():
            return self.kept(self.known, chunk, self.plain(" " + chunk))
        ids = self.words.get(word)
        if ids is None:
            ids = self.kept(self.words, word, array("I", self.encoding._encode_single_piece(" " + word)).tobytes())
        if len(word) == len(chunk):
            return self.kept(self.known, chunk, ids)
        tail = chunk[len(word) :]
        rest = self.tails.get(tail)
        if rest is None:
            rest = self.kept(self.tails, tail, self.plain(tail))
        return self.kept(self.known, chunk, ids + rest)

    def ids(self, text: str) -> bytes:
        parts = self.at_added.split(text) if self.at_added else [text]
        # every second part is an added token
        return b"".join(self.added[part] if i % 2 else self.between(part) for i, part in enumerate(parts))

    def between(self, text: str) -> bytes:
        if self.FAR.search(text):
            first, *rest = self.BEFORE_BLANK.split(text)
            rest = [c[1:] for c in rest]
        else:
            first, *rest = text.split(" ")
        found = list(map(self.known.get, rest))
        if None in found:
            found = [self.chunk(c) if hit is None else hit for c, hit in zip(rest, found)]
        return self.plain(first) + b"".join(found)


def cut(ids: bytes, capacity: int, keep_ids: bool) -> list[tuple]:
    """Pieces of a closed document; the first one is the shorter one."""
    n = len(ids) // 4
    first = n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return [
        (i, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), ids[4 * a : 4 * b] if keep_ids else None)
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ]


def pieces(text: Column, capacity: int = CAPACITY, closing: int = CLOSING_ID, path: str | None = None, keep_ids: bool = False) -> Column:
    """Array of the pieces of a text column, tokenised in Arrow batches."""
    path = path or vocabulary_path()
    closing_bytes = int(closing).to_bytes(4, "little")

    @F.pandas_udf(PIECES)
    def tokenised(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chunks = worker_state(("chunks", path), lambda: Chunks(path))
        for batch in batches:
            yield pd.Series([cut(chunks.ids(t or "") + closing_bytes, capacity, keep_ids) for t in batch])

    return tokenised(text)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item, items taken longest first.  All items are known, so a new
    bin is opened only for an item that no open bin can take."""
    none = np.iinfo(np.int64).max
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    places = np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins per gap
    stacks: dict[int, list[int]] = {}
    opened = 0
    for item in order:
        s = int(lengths[item])
        gap = capacity
        if s < capacity:
            # change of the sum when a bin of gap g becomes one of gap g - s
            change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
            change[0] -= 1  # a full bin leaves the sum
            change[count[s:capacity] == 0] = none
            best = int(np.argmin(change))
            if change[best] < none:
                gap = best + s
        if gap == capacity:
            number, opened = opened, opened + 1
        else:
            number = stacks[gap].pop()
            count[gap] -= 1
        bins[item], places[item] = number, capacity - gap
        if gap > s:
            stacks.setdefault(gap - s, []).append(number)
            count[gap - s] += 1
    return bins, places


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "item"], kind="stable", ignore_index=True)
    bins, places = sum_of_squares(rows["length"].to_numpy(), capacity)
    fill = np.bincount(bins, rows["length"])[bins]
    return rows.assign(bin=bins, offset=places, fill=fill.astype(np.int64))


def place(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``item``, ``sequence_id`` and ``offset`` of a written table of (item, length)."""
    schema = "item long, length long, pile long, bin long, offset long, fill long"
    done = [items.where(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = items.where(F.col("length") < capacity).select("item", "length")
    left = rest.count()
    for round_number in range(1, 100):
        piles = max(1, -(-left // group))
        dealt = rest.withColumn("pile", F.pmod(F.xxhash64("item", F.lit(round_number)), F.lit(piles)))
        packed = cut_lineage(
            dealt.groupBy("pile").applyInPandas(lambda rows: pack_group(rows, capacity)[["item", "length", "pile", "bin", "offset", "fill"]], schema), "packed"
        )
        open_rows = packed.where(F.col("fill") < ENOUGH * capacity)
        still = 0 if piles == 1 else open_rows.count()
        # taking apart pays only while most of a group is full
        last = still * 2 > left or still == 0
        kept = packed if last else packed.where(F.col("fill") >= ENOUGH * capacity)
        number = F.lit(-(round_number << 56)) - F.shiftleft(F.col("pile"), 24) - F.col("bin") - 1
        done.append(kept.select("item", number.alias("sequence_id"), "offset"))
        if last:
            break
        rest, left = open_rows.select("item", "length"), still
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def packed_pieces(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its place there; with ``keep_ids`` also the
    token ids (little-endian 32-bit).  ``copy_id`` numbers the rows of ``docs``, so the pieces
    of rows with equal ``doc_id`` can be told apart: (copy_id, piece) is unique."""
    numbered = docs.select(F.monotonically_increasing_id().alias("copy_id"), "doc_id", "text")
    cut_up = numbered.select("copy_id", "doc_id", F.explode(pieces(F.col("text"), capacity, CLOSING_ID, path, keep_ids)).alias("p"))
    columns = ["piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    table = cut_lineage(cut_up.select(F.monotonically_increasing_id().alias("item"), "copy_id", "doc_id", *[f"p.{c}" for c in columns]), "pieces")
    placed = place(table, capacity)
    return table.join(placed, "item").select("doc_id", *columns[:4], "sequence_id", "offset", *columns[4:], "copy_id")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces that kept theirs.  A sequence has at most
    as many pieces as tokens, so a group is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    hexed = F.array_join(F.transform(parts, lambda p: F.hex(p.ids)), "")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(hexed).alias("ids"))
