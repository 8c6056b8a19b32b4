"""Document fingerprints by MinHash.

A fingerprint holds, for each of ``PERMUTATIONS`` universal hash permutations of the 32-bit
numbers, the smallest image of a text's word shingles; the share of equal places estimates
the Jaccard likeness of two texts.  Signatures are computed in vectorised numpy.  Near
duplicates are found by joining bands of the signature in Spark; pairs that share a band are
verified on the shingles themselves, in rounds that pass over what is connected already.

Defined cases: a null text is empty; a text without words has the fingerprint of the empty
set, alike only to itself; a text of fewer words than a shingle is one shingle; texts of
equal words have equal fingerprints, so repeated rows have; rows of equal id are ordered by
a hash of their text, null ids come last; an empty table gives no rows; other columns play no
part.  Texts of any length are read as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.llm.common import cut_lineage, free_name, shuffle_width
from bibliomill.llm.linking import connected, rare_members

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 32
LIKENESS = 0.8
AT_ONCE = 2048
EMPTY = np.uint32(0xFFFFFFFF)


def permutations(count: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands; x -> a x + b mod 2^32 is a permutation of the 32-bit numbers."""
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def shingles(text: str, words: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of the word shingles of a text, in order."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "replace").split()
    if not parts:
        return np.empty(0, np.uint32)
    hashes = np.array(list(map(xxh64_intdigest, parts)), np.uint64)
    size = min(words, len(parts))
    n = len(parts) - size + 1
    with np.errstate(over="ignore"):
        total = np.full(n, size, np.uint64)
        for i in range(size):
            total = (total ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    return (total >> np.uint64(32)).astype(np.uint32)


def signature(values: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = hashes
    out = np.full(len(a), EMPTY)
    for at in range(0, len(values), AT_ONCE):
        block = values[at : at + AT_ONCE]
        np.minimum(out, (a[:, None] * block + b[:, None]).min(axis=1), out=out)
    return out


def as_text(sig: np.ndarray) -> str:
    """The lower 16 bits of each place, in hexadecimal; the upper ones of a minimum hardly vary."""
    return (sig & np.uint32(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


# ---- a document, its edited text and its neighbour ---------------------------------


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _ordered_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows by ranges of falling doc_id, sorted inside, each range followed by the first row
    of the next one (``extra``), and the last range by the first row of all.

    Ranges come from approximate percentiles of the ids; what reaches the driver is one
    border and one id per range.
    """
    docs = docs.select("doc_id", "text")
    ids = docs.select("doc_id")
    shares = [i / buckets for i in range(1, buckets)]
    borders = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []), reverse=True) if shares else []
    border_list = F.lit(borders) if borders else F.array().cast("array<bigint>")
    powers = [1 << p for p in reversed(range(max(1, len(borders).bit_length())))]

    def search(at: Column, step: Column) -> Column:
        # number of borders above the id, by halving steps over the falling borders
        further = (at + step <= len(borders)) & (F.try_element_at(border_list, at + step) > F.col("doc_id"))
        return F.when(further, at + step).otherwise(at)

    found = F.aggregate(F.array(*[F.lit(p) for p in powers]), F.lit(0), search)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(borders))).otherwise(found) if borders else F.lit(0)
    heads = sorted(((r.bucket, r.head) for r in ids.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()))
    numbers = [b for b, _ in heads]
    before = {b: numbers[i - 1] for i, b in enumerate(numbers)}  # of the first: the last
    slots = len(borders) + 1
    head_of = F.lit([dict(heads).get(b) for b in range(slots)]) if any(h is not None for _, h in heads) else F.array_repeat(F.lit(None).cast("long"), slots)
    to = F.lit([before.get(b, 0) for b in range(slots)])
    is_head = F.col("doc_id").eqNullSafe(F.element_at(head_of, F.col("bucket") + 1))
    target = F.when(is_head, F.element_at(to, F.col("bucket") + 1))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bucket.cast("int").alias("bucket")).select(
        "doc_id", "text", F.explode(F.array_compact(F.array(own, F.when(is_head, F.struct(target.cast("int").alias("bucket"), F.lit(True).alias("extra")))))).alias("p")
    )
    return (
        rows.select("doc_id", "text", "p.bucket", "p.extra")
        .repartition(shuffle_width(docs.sparkSession), "bucket")
        .sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    hashes = permutations()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None  # the last document of a range that has not met the next one
        for batch in batches:
            out = []
            for doc_id, text, bucket, extra in zip(batch["doc_id"], batch["text"], batch["bucket"], batch["extra"]):
                if extra and (waiting is None or waiting[0] != bucket):
                    continue  # a second row that shares the id of the first
                sig = signature(shingles(text), hashes)
                if waiting is not None and waiting[0] == bucket:
                    _, last_id, last, last_sig = waiting
                    new = edited(last, text)
                    new_sig = signature(shingles(new), hashes)
                    digest = hashlib.sha256(new.encode("utf-8", "replace")).hexdigest()
                    out.append((last_id, len(last), digest, as_text(last_sig), as_text(new_sig), likeness(last_sig, new_sig), likeness(last_sig, sig)))
                waiting = None if extra else (bucket, doc_id, text, sig)
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = pd.array([None if pd.isna(i) else int(i) for i in frame["doc_id"]], "Int64")
            yield frame

    buckets = max(1, 4 * shuffle_width(docs.sparkSession))
    return _ordered_buckets(docs, buckets).mapInPandas(compare, schema)


# ---- near duplicates -----------------------------------------------------------------


def signed(text: Column, seed: int = 0) -> Column:
    """Digest of the shingle set, its first half as the class, size, signature and band keys of
    a text column."""
    hashes = permutations()
    per_band = PERMUTATIONS // BANDS

    @F.pandas_udf("signature binary, digest binary, class long, size long, bands array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                found = np.unique(shingles(text or ""))
                sig = signature(found, hashes)
                keys = [int.from_bytes(hashlib.blake2b(sig[i : i + per_band].tobytes(), digest_size=8, salt=b"%d" % i).digest(), "big", signed=True) for i in range(0, PERMUTATIONS, per_band)]
                digest = hashlib.blake2b(found.tobytes(), digest_size=16, salt=b"%d" % seed).digest()
                out.append((sig.tobytes(), digest, int.from_bytes(digest[:8], "big", signed=True), len(found), keys))
            yield pd.DataFrame(out, columns=["signature", "digest", "class", "size", "bands"])

    return made(text)


def with_signatures(docs: DataFrame, text: Column, column: str, row: str) -> DataFrame:
    """The documents with their signatures and a row number, written; two classes never share
    a number."""
    seed = 0
    while True:
        marked = cut_lineage(docs.withColumn(column, signed(text, seed)).withColumn(row, F.monotonically_increasing_id()), "signatures")
        per_class = marked.groupBy(f"{column}.class", f"{column}.digest").agg(F.lit(1)).groupBy("class").count()
        digests, classes = per_class.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
        if digests == classes:
            return marked
        seed += 1


def _shingle_set(text: Column) -> Column:
    @F.pandas_udf("binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(shingles(t or "")).tobytes() for t in batch], dtype=object)

    return made(text)


def class_roots(rows: DataFrame, least: float = LIKENESS) -> DataFrame:
    """``class`` and ``root``, the class that stands for all those reachable by links of
    likeness ``least`` or more, of the classes that are not their own root; for a written table
    of (row, text, class, size, bands).

    Bands whose texts are the same as another band's are compared once, and shingles are cut
    again only for one text of each class that shares a band.  A band of many classes is joined
    by rounds with leaders (``linking``), so the pairs of a group of near copies grow with its
    size and not with its square.  Rare shingles only thin out the pairs of crowded bands:
    classes without a common band are never compared.
    """
    of_class = cut_lineage(rows.groupBy("class").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands")), "classes")
    banded = of_class.select("class", "size", F.explode("bands").alias("band"))
    members = [F.count(F.lit(1)).alias("n"), F.sum(F.col("class").cast("decimal(38,0)")).alias("total"), F.bit_xor("class").alias("odd")]
    shared = banded.groupBy("band").agg(*members).where("n > 1").groupBy("n", "total", "odd").agg(F.min("band").alias("band")).select("band", "n")
    met = banded.join(cut_lineage(shared, "bands").hint("merge"), "band")
    met = cut_lineage(met.select(F.col("band").alias("sig"), F.lit(0).alias("kind"), F.col("class").alias("node"), "size", F.lit(True).alias("asks"), F.lit(True).alias("told"), F.col("n").alias("crowd")), "met")
    standing = of_class.join(met.select(F.col("node").alias("class")).distinct().hint("merge"), "class").select("row", F.col("class").alias("node"))
    sets = rows.select("row", "text").join(standing.hint("merge"), "row").select("node", _shingle_set(F.col("text")).alias("set"))
    sets = cut_lineage(sets, "shingles")

    def alike(a: int, b: int, both: int) -> bool:
        return both >= least * (a + b - both)

    of_node = met.groupBy("node").agg(F.collect_set("sig").alias("bands"))

    def share_a_band(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(of_node.select(F.col("node").alias(end), F.col("bands").alias(f"bands_{end}")), end)
        return pairs.where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b", "hub")

    roots = connected(
        met, lambda nodes: sets, alike, "uint32", least,
        finer=lambda crowd: rare_members(crowd, "uint32", least), sharing=share_a_band,
    )
    return roots.select(F.col("node").alias("class"), "root")


def near_duplicates(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """doc_id and class_id (the smallest id reachable by links of likeness ``least`` or more)
    of every document."""
    marked = with_signatures(docs.select("doc_id", "text"), F.col("text"), "s", "row")
    rows = marked.select("doc_id", "text", "row", "s.class", "s.size", "s.bands")
    rooted = rows.groupBy("class").agg(F.min("doc_id").alias("least")).join(class_roots(rows, least), "class", "left")
    rooted = rooted.select("class", "least", F.coalesce("root", "class").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    return rows.select("doc_id", "class").join(rooted.join(smallest, "root").select("class", "class_id"), "class").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """One document of each class of near duplicates, words compared in lower case: the one
    with the smallest id, nulls last; among rows with that id, the smallest by content."""
    row, sign = free_name(docs, "row"), free_name(docs, "sign")
    marked = with_signatures(docs, F.lower("text"), sign, row)
    rows = marked.select(F.col(row).alias("row"), F.lower("text").alias("text"), *[F.col(f"{sign}.{c}").alias(c) for c in ("class", "size", "bands")])
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("digest"), F.col(row).alias("row"))).alias("best")
    of_class = marked.groupBy(F.col(f"{sign}.class").alias("class")).agg(best)
    rooted = of_class.join(class_roots(rows, least), "class", "left").select("best", F.coalesce("root", "class").alias("root"))
    first = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return marked.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
