"""Exact Jaccard join of word n-grams by universe partition.

The sets of a band of sizes are cut into segments by the hash of their members, so that two
sets that are alike enough differ in fewer members than they have segments, and the segments
of a set are its index keys.  A set looks others up with an allowance for each segment: 0
passes it over, 1 finds equal segments, 2 finds those that differ by one member, through the
keys of the segments with one member left out.  When the allowances of a set sum up to more
than its greatest difference, one of its segments must find every partner.

Which segments get which allowance is decided by cost.  One shuffle brings equal keys
together; keys of one set alone are free and vanish.  A set whose free segments suffice looks
nothing up; others add the cheapest of the rest, so a passage that many documents share is
hardly ever looked up.  Candidates are verified on the whole sets of 64-bit hashes and joined
to components (``linking``).

Defined cases: a null text is empty; a text without words has the empty set and is linked with
nothing; a text of fewer words than an n-gram is one n-gram; texts of equal words are one
class, so repeated rows are; a null id never names a component unless all its members are
null; an empty table gives no rows; other columns play no part.  Texts of any length are read
as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.llm.common import broadcast_up_to, cut_lineage, shuffle_width
from bibliomill.llm.linking import KNOWN, connected, rare_members

WORDS = 5
LEAST = 80
# Segments, from the first, that are also indexed with one member left out: all of small sets,
# one of others, whose spare segments do for most and cost fewer keys.
RESERVE, RESERVE_OF_MANY, MANY = 8, 1, 16
# One segment more for so many, to pass over what many sets share.
SPARE = 12
# Pairs left for each asking row, which may stand for many keys, from which a crowd is compared
# by its rarest n-grams.
CROWDED = 2
# Rows handed on at once, and bytes of text hashed at once.
ROWS_AT_ONCE = 500_000
BYTES_AT_ONCE = 2 << 20
# Words of more bytes are hashed one by one.
LONG_WORD = 256
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
KEPT_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
TOLD, ASKS, LEFT_OUT, WIDE, LOWER, PLAIN = 1, 2, 4, 8, 16, 32
# Bits of the flags, and of segment and flags; the spare units follow.
FLAGS, PLACED = 6, 38


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text begins
    and the last one ends among them.

    A word is hashed by blocks of 8 bytes, its length first; very long ones by xxHash.
    """
    from xxhash import xxh64_intdigest

    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    if not len(held):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = np.append(LOWERED[held], np.zeros(8, np.uint8))
    word = IN_WORD[held]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    # no word reaches into the next text
    first, last = bounds[bounds < len(held)], bounds[bounds > 0] - 1
    begins[first], ends[last] = word[first], word[last]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    blocks = np.ndarray((len(held) + 1,), "<u8", low, strides=(1,))
    hashes = _mixed(lengths.astype(np.uint64) + np.uint64(1 << 40))
    open_, at = np.arange(len(starts)), 0
    while len(open_) and at < LONG_WORD:
        left = lengths[open_] - at
        block = blocks[starts[open_] + at] & KEPT_BYTES[np.minimum(left, 8)]
        hashes[open_] = _mixed(hashes[open_] ^ block)
        open_, at = open_[left > 8], at + 8
    for i in open_:
        hashes[i] = xxh64_intdigest(low[starts[i] : starts[i] + lengths[i]].tobytes())
    return hashes, np.searchsorted(starts, bounds)


def sets_from(hashes: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Rising distinct 64-bit hashes of the n-grams of each text."""

    def grams(part: np.ndarray, n: int) -> np.ndarray:
        total = np.full(max(0, len(part) - n + 1), n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                total = (total ^ part[i : i + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
        return total

    of_all = grams(hashes, size)
    for lo, hi in zip(first[:-1], first[1:]):
        if lo == hi:
            yield np.empty(0, np.uint64)
            continue
        found = np.sort(of_all[lo : hi - size + 1]) if hi - lo >= size else grams(hashes[lo:hi], int(hi - lo))
        yield found[np.append(True, found[1:] != found[:-1])]


def digest_of(hashes: np.ndarray, seed: int) -> bytes:
    """128-bit digest of a text's hashed words; its first half is the node's number."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16, salt=b"%d" % seed).digest()


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``BYTES_AT_ONCE`` of text, one text at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // BYTES_AT_ONCE
        edges = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(piece) else []
        for lo, hi in zip(edges, [*edges[1:], len(piece)]):
            yield batch.slice(lo, hi - lo)


def difference(r: int, s: int, least: int = LEAST) -> int:
    """Greatest symmetric difference of alike sets of these sizes."""
    return (100 - least) * (r + s) // (100 + least)


@lru_cache(maxsize=8)
def bands(least: int = LEAST) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, segments); a set's partners of its size or less lie in its
    own band or the one below."""
    if not 50 <= least <= 100:
        raise ValueError("the least likeness must be 50 to 100 percent")
    out, low = [], 1
    while low < 1 << 40:
        high = max(low + 1, -(-low * 120 // least)) - 1
        greatest = difference(high, high * 100 // least, least)
        out.append((low, high, greatest + 1 + greatest // SPARE))
        low = high + 1
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Cut:
    """A set cut into the segments of one band, as the lookups of that band need it."""

    def __init__(self, members: np.ndarray, band: int, lower: bool, least: int):
        _, high, self.segments = bands(least)[band]
        self.members, self.band, self.lower = members, band, lower
        # rising members lie in rising segments
        self.of = ((members >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64)
        self.sizes = np.bincount(self.of, minlength=self.segments)
        self.reserve = RESERVE if self.segments <= MANY else RESERVE_OF_MANY
        self.wide = (self.sizes >= 2) & (np.arange(self.segments) < self.reserve)
        need = difference(min(len(members), high), len(members), least) + 1
        units = int((self.sizes > 0).sum() + self.wide.sum())
        # too few segments hold anything: the empty ones are looked up too
        self.all_asked = units < need
        self.spare = units + (int((self.sizes == 0).sum()) if self.all_asked else 0) - need

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Signatures and what they stand for (spare units, segment and flags)."""
        number = np.arange(self.segments, dtype=np.int64)
        mixed = _mixed(self.members)
        with np.errstate(over="ignore"):
            signature = _mixed(number.astype(np.uint64) + np.uint64(self.band << 40) + np.uint64(1 << 50))
            full = np.flatnonzero(self.sizes)
            starts = (np.cumsum(self.sizes) - self.sizes)[full]
            signature[full] += np.add.reduceat(mixed, starts)
            left = np.flatnonzero(self.wide[self.of[: int(self.sizes[: self.reserve].sum())]])
            without = signature[self.of[left]] - mixed[left]
        exact = np.where(self.sizes > 0, TOLD | ASKS, TOLD | (ASKS if self.all_asked else 0)) | np.where(self.wide, WIDE, 0) | np.where(number >= self.reserve, PLAIN, 0)
        flags = np.concatenate([exact, np.full(len(left), TOLD | ASKS | LEFT_OUT | WIDE)])
        if self.lower:
            flags = flags & ~TOLD | LOWER
        # a segment that is only looked up whole needs no number
        place = np.concatenate([np.where(number < self.reserve, number, 0), self.of[left]])
        info = self.spare << PLACED | place << FLAGS | flags
        used = (flags & (TOLD | ASKS)) > 0
        return np.concatenate([signature, without])[used], info[used]


def cuts(members: np.ndarray, least: int = LEAST) -> list[Cut]:
    """The set in its own band, and in the one below where smaller partners lie."""
    size, known = len(members), bands(least)
    if not size:
        return []
    band = next(i for i, (_, high, _) in enumerate(known) if size <= high)
    own = [Cut(members, band, False, least)]
    reach = -(-size * least // 100)
    return own + [Cut(members, band - 1, True, least)] if band and reach <= known[band - 1][1] else own


# ---- passes over the texts -------------------------------------------------------------


def classes(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, node, digest, n_shingles, of_text) of every document, the last a hash of the text as it is."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            hashes, first = hashed_words(batch.column("text"))
            digests = [digest_of(hashes[lo:hi], seed) for lo, hi in zip(first[:-1], first[1:])]
            sizes = [len(found) for found in sets_from(hashes, first, words)]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(map(node_of, digests), pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("of_text")], ["doc_id", "node", "digest", "n_shingles", "of_text"])

    read = docs.select("doc_id", "text", F.xxhash64("text").alias("of_text"))
    return read.mapInArrow(measured, "doc_id long, node long, digest binary, n_shingles long, of_text long")


def new_texts(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Nodes not met before, with the hashes of their words and where each begins among them."""
    seen: set[int] = set()
    for batch in in_pieces(batches):
        hashes, first = hashed_words(batch.column("text"))
        nodes = [node_of(digest_of(hashes[lo:hi], seed)) for lo, hi in zip(first[:-1], first[1:])]
        new = [i for i, node in enumerate(nodes) if node not in seen and not seen.add(node)]
        if len(new) < len(nodes):
            lengths = np.diff(first)
            kept = np.zeros(len(nodes), bool)
            kept[new] = True
            hashes = hashes[np.repeat(kept, lengths)]
            first = np.append(0, np.cumsum(lengths[kept]))
            nodes = [nodes[i] for i in new]
        yield nodes, hashes, first


def index_rows(docs: DataFrame, words: int, least: int, seed: int) -> DataFrame:
    """(sig, node, info) of the segments of every class, once in each task that meets it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def handed_on() -> pa.RecordBatch:
            sigs, infos, nodes = zip(*held)
            columns = [np.concatenate(sigs).view(np.int64), np.repeat(np.array(nodes, np.int64), [len(s) for s in sigs]), np.concatenate(infos)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "node", "info"])

        for nodes, hashes, first in new_texts(batches, seed):
            for node, found in zip(nodes, sets_from(hashes, first, words)):
                for part in cuts(found, least):
                    sig, info = part.keys()
                    held.append((sig, info, node))
                    n += len(sig)
                if n >= ROWS_AT_ONCE:
                    yield handed_on()
                    held, n = [], 0
        if held:
            yield handed_on()

    return docs.select("text").mapInArrow(cut, "sig long, node long, info long")


def sets_of(docs: DataFrame, hashed: DataFrame, nodes: DataFrame, words: int, seed: int) -> DataFrame:
    """(node, set) of the wanted nodes, read again from one text of each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, hashes, first in new_texts(batches, seed):
            found = [s.tobytes() for s in sets_from(hashes, first, words)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, pa.binary())], ["node", "set"])

    named = cut_lineage(hashed.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("of_text").alias("of_text")), "named")
    texts = docs.select("text", F.xxhash64("text").alias("of_text")).join(broadcast_up_to(named.select("of_text"), KNOWN), "of_text", "left_semi")
    # another text may have the hash of a wanted one
    found = texts.dropDuplicates(["of_text", "text"]).select("text").mapInArrow(cut, "node long, set binary")
    return found.join(broadcast_up_to(named.select("node"), KNOWN), "node", "left_semi")


# ---- the join ----------------------------------------------------------------------------


def allotted(asking: DataFrame) -> DataFrame:
    """The asking rows of the cheapest allowances that each set cannot do without.

    The first unit of a segment costs what equal segments it meets, the second what those with
    one member less or more do, and no less than the first, which it needs.  A row that stands
    for several segments gives that many units at once.
    """
    of_set, of_segment = ["node", "lower"], ["node", "lower", "segment"]
    costs = asking.groupBy(*of_segment).agg(
        *[F.sum(F.when(F.col("unit") == u, F.col("foreign")).otherwise(0)).alias(f"cost{u}") for u in (1, 2)],
        F.max("wide").alias("wide"), F.max("spare").alias("spare"), F.max("units").alias("units"),
    )
    first = F.when(F.col("cost1") > 0, F.struct(F.lit(1).alias("unit"), F.col("cost1").alias("cost")))
    second = F.when(F.col("wide"), F.struct(F.lit(2).alias("unit"), F.greatest("cost1", "cost2").alias("cost")))
    units = costs.select(*of_segment, "spare", "units", F.explode(F.array_compact(F.array(first, second))).alias("u")).select(*of_segment, "spare", "units", "u.*")
    by_cost = Window.partitionBy(*of_set).orderBy(F.col("cost") / F.col("units"), "segment", "unit").rowsBetween(Window.unboundedPreceding, 0)
    paid = units.withColumn("place", F.sum("units").over(by_cost)).withColumn("costly", F.sum("units").over(Window.partitionBy(*of_set)))
    paid = paid.where(F.col("place") - F.col("units") < F.col("costly") - F.col("spare")).groupBy(*of_segment).agg(F.max("unit").alias("allowance"))
    return asking.join(paid, of_segment).where("unit <= allowance").drop("allowance")


def lookups(met: DataFrame) -> DataFrame:
    """Asking and told-of rows of keys that several sets share."""
    flag = lambda bit: F.col("info").bitwiseAND(F.lit(bit)) > 0
    left_out, told, asks, wide = flag(LEFT_OUT), flag(TOLD), flag(ASKS), flag(WIDE)

    def row(kind: Column, unit: Column, asking: Column, telling: Column, when: Column) -> Column:
        return F.when(when, F.struct(kind.alias("kind"), unit.alias("unit"), asking.alias("asks"), telling.alias("told")))

    yes, no = F.lit(True), F.lit(False)
    as_written = row(F.when(left_out, 1).otherwise(0), F.lit(1), asks & ~left_out, told, told | (asks & ~left_out))
    one_less = row(F.lit(0), F.lit(2), yes, no, asks & left_out)
    one_more = row(F.lit(1), F.lit(2), yes, no, asks & wide & ~left_out)
    lower = flag(LOWER)
    return met.select(
        "sig", "node", "size", "crowd", "units", lower.alias("lower"), F.when(flag(PLAIN), F.col("sig")).otherwise(F.shiftright(F.col("info").bitwiseAND(F.lit((1 << PLACED) - 1)), FLAGS)).alias("segment"), wide.alias("wide"),
        F.shiftright("info", PLACED).alias("spare"), F.explode(F.array_compact(F.array(as_written, one_less, one_more))).alias("r"),
    ).select("sig", "r.kind", "node", "size", "crowd", "units", "lower", "segment", "wide", "spare", "r.unit", "r.asks", "r.told")


def met_rows(rows: DataFrame) -> DataFrame:
    """(sig, node, info, crowd, units) of index rows whose key several sets share.

    Near copies share most of their segments, so many keys bring the very same sets together.
    Of those that are not looked up with a member left out, one stands for all, with as many
    units; keys are told apart by the hash of their sets and flags, with the least and greatest node.
    """
    same = Window.partitionBy("sig")
    # 48 bits of the hash, so that the sum cannot overflow
    held = F.shiftright(F.xxhash64("node", "info"), 16)
    shared = rows.select(
        "*", F.min("node").over(same).alias("low"), F.max("node").over(same).alias("high"), F.max(F.col("info").bitwiseAND(F.lit(ASKS))).over(same).alias("asked"),
        F.count(F.lit(1)).over(same).alias("crowd"), F.sum(held).over(same).alias("held"),
    ).where("low < high AND asked > 0")
    plain = F.col("info").bitwiseAND(F.lit(PLAIN)) > 0
    members = F.when(plain, F.xxhash64("held", "low", "high", "crowd")).otherwise(F.col("sig")).alias("members")
    placed = shared.select("sig", "node", "info", "crowd", members)
    placed = placed.repartition(shuffle_width(rows.sparkSession), "node").distinct()
    one = placed.groupBy("node", "members", "info", "crowd").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("units"))
    return one.select("sig", "node", "info", (F.col("crowd") * F.col("units")).alias("crowd"), "units")


def jaccard_classes(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal words (doc_id, node, n_shingles) and roots (node, root) of the classes
    that are linked with a smaller one."""
    seed = 0
    while True:
        hashed = cut_lineage(classes(docs, words, seed), "classes")
        digests, nodes = hashed.groupBy("node", "digest").agg(F.lit(1)).groupBy("node").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
        if digests == nodes:
            break
        seed += 1  # two classes share a number: number them anew
    of_node = hashed.groupBy("node").agg(F.first("n_shingles").alias("size"))
    met = cut_lineage(lookups(met_rows(index_rows(docs, words, least, seed)).join(of_node, "node")), "met")

    def alike(a: int, b: int, shared: int) -> bool:
        return 100 * shared >= least * (a + b - shared)

    def sets_for(nodes: DataFrame) -> DataFrame:
        return cut_lineage(sets_of(docs, hashed, nodes, words, seed), "sets")

    return hashed, connected(met, sets_for, alike, "uint64", least / 100, allotted, lambda crowd: rare_members(crowd, "uint64", least / 100), crowded=CROWDED)


def join_report(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """Size of its set and component of every document."""
    hashed, roots = jaccard_classes(docs, least, words)
    of_class = hashed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = of_class.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(smallest, "root").select("node", "component")
    return hashed.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


JOIN_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
sh AS (
  SELECT DISTINCT r, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(list_slice(words, i, i + 4), ' ') END AS s
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT r, count(*) AS size FROM sh GROUP BY r),
both_ways AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
links AS (
  SELECT a, b FROM both_ways JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 80 * (x.size + y.size - shared)),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(any_value(n.size), 0)::bigint AS n_shingles, min(o.doc_id) AS component_id
FROM w LEFT JOIN n ON n.r = w.r JOIN reach ON reach.a = w.r JOIN w o ON o.r = reach.b GROUP BY w.r, w.doc_id
"""
