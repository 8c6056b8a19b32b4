"""Many literal terms found in one pass over each text.

The terms become an automaton that follows all of them at once, so the time of a text depends
on its length and on what is found, not on how many terms are looked for.  It travels with the
plan; a worker builds it once and keeps it for the tasks that follow.  A vocabulary too large
for that is told from other strings by a filter of bounded size, in one pass as well.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliomill.session import cut_lineage

# Functions run by Python workers travel by value: no executor needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Terms and bytes of one automaton; what it finds costs more to hand on than what a filter finds.
SHARD_TERMS = 4_000
SHARD_BYTES = 1 << 20


def _kept(key: str, make: Callable[[], object]) -> object:
    """A value a Python worker keeps from task to task, the last one only."""
    held = sys.__dict__.setdefault("_bibliomill_automaton", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def _automaton(words: Sequence[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, word in enumerate(words):
        machine.add_word(word, (i, len(word)))
    machine.make_automaton()
    return machine


def _places(machine, text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Terms of a text by number, how often each occurs without overlap, and where first."""
    seen: dict[int, list[int]] = {}
    for end, (i, size) in machine.iter(text) if text else ():
        met = seen.get(i)
        if met is None:
            seen[i] = [1, end, end - size + 1]
        elif end - size >= met[1]:
            met[0] += 1
            met[1] = end
    return list(seen), [m[0] for m in seen.values()], [m[2] for m in seen.values()]


def found_terms(text: Column, words: Sequence[str]) -> Column:
    """Array of (term, n, first) for the terms a text contains: occurrences that do not
    overlap, and the offset of the first, from 0."""
    key = hashlib.sha256("\0".join(words).encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf("term array<string>, n array<long>, first array<long>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = _kept(key, lambda: _automaton(words)) if words else None
        names = np.array(words, dtype=object)
        for batch in batches:
            found = [_places(machine, text) if machine else ([], [], []) for text in batch]
            yield pd.DataFrame(
                {"term": [names[i].tolist() for i, _, _ in found], "n": [n for _, n, _ in found], "first": [f for _, _, f in found]},
                columns=["term", "n", "first"],
            )

    spots = places(text)
    return F.arrays_zip(spots["term"].alias("term"), spots["n"].alias("n"), spots["first"].alias("first"))


# ---- vocabularies too large for an automaton ---------------------------------------------

# A filter of terms takes so many bits a term, up to the size of a broadcast.
FILTER_BITS = 16
FILTER_BYTES = 32 << 20
# Bytes of text looked at together.
CHUNK_BYTES = 1 << 20
# A place is asked for longer terms only while its first 4, 8, 16, ... bytes begin one.
FIRST_STEP = 4

_BASE, _ODD, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
_BYTES = np.random.default_rng(20_261_204).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int, of: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Hashes:
    """Hashes of any stretch of a byte string, by sums over its beginnings."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers(len(data), int(_BASE)), out=self.sums[1:])
        self.back = _powers(len(data) + 1, pow(int(_BASE), -1, 1 << 64))

    def of(self, at: np.ndarray, size: int | np.ndarray, whole: bool) -> np.ndarray:
        """Hash of the ``size`` bytes at each place, as a whole term or as a beginning."""
        salt = np.atleast_1d(np.asarray(size, np.uint64)) * np.uint64(2) + np.uint64(whole)
        x = (self.sums[at + size] - self.sums[at]) * self.back[at] ^ salt * _ODD
        x ^= x >> np.uint64(32)
        x *= _ODD
        return x ^ x >> np.uint64(29)


def _bits(x: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a filter of 2 ** power bits."""
    down = np.uint64(64 - power)
    return (x * _BASE) >> down, (x * _SECOND) >> down


def _held(x: np.ndarray, bits: np.ndarray, power: int) -> np.ndarray:
    """Numbers of the hashes both bits of which are set."""
    one, two = _bits(x, power)
    some = np.flatnonzero(bits[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8) & 1)
    two = two[some]
    return some[(bits[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings, and where each string begins; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, borders, data = texts.buffers()
    starts = np.frombuffer(borders, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.empty(0, np.uint8)
    return data, starts - starts[0]


def _steps(longest: int) -> list[int]:
    return [FIRST_STEP << i for i in range(64) if FIRST_STEP << i < longest]


def _grouped(data: np.ndarray, row: np.ndarray, at: np.ndarray, x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of occurrences without overlap, for each row and string of
    ``size`` bytes; places rise."""
    order = np.argsort(x ^ row.astype(np.uint64) * _SECOND, kind="stable")
    at, row, x = at[order], row[order], x[order]
    same = np.flatnonzero((x[1:] == x[:-1]) & (row[1:] == row[:-1])) + 1
    clash = np.zeros(len(same), bool)
    for i in range(size if len(same) else 0):
        clash |= data[at[same] + i] != data[at[same - 1] + i]
    first = np.ones(len(at), bool)
    first[same] = False
    if clash.any():
        # two strings of one hash: told apart by what they are
        met: dict[tuple[int, bytes], list[int]] = {}
        for r, a in sorted(zip(row.tolist(), at.tolist())):
            met.setdefault((r, data[a : a + size].tobytes()), []).append(a)
        groups = list(met.values())
        return np.array([g[0] for g in groups], np.int64), np.array([_apart(g, size) for g in groups], np.int64)
    begins = np.flatnonzero(first)
    n = np.diff(np.append(begins, len(at)))
    near = same[at[same] - at[same - 1] < size]
    for g in np.unique(np.searchsorted(begins, near, "right") - 1).tolist():
        n[g] = _apart(at[begins[g] : begins[g] + n[g]].tolist(), size)
    return at[begins], n


def _apart(places: list[int], size: int) -> int:
    """How many of rising places are taken when each must begin where the last one ended or later."""
    n, end = 0, -1
    for a in places:
        if a >= end:
            n, end = n + 1, a + size
    return n


def _found(data: np.ndarray, starts: np.ndarray, bits: np.ndarray, power: int, sizes: list[int]) -> list[np.ndarray]:
    """(row, place, size, n) of the strings the filter holds."""
    hashes = _Hashes(data)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = np.append(data & 0xC0 != 0x80, True)  # where a character begins
    at = np.flatnonzero(whole[:-1])
    room = starts[row[at] + 1] - at
    steps = _steps(sizes[-1] if sizes else 0)
    out = []
    for size in sizes:
        while steps and steps[0] < size:
            fits = np.flatnonzero(room > steps[0])
            kept = fits[_held(hashes.of(at[fits], steps.pop(0), False), bits, power)]
            at, room = at[kept], room[kept]
        fits = at[room >= size]
        fits = fits[whole[fits + size]]
        x = hashes.of(fits, size, True)
        hit = _held(x, bits, power)
        if len(hit):
            place, n = _grouped(data, row[fits[hit]], fits[hit], x[hit], size)
            out.append((row[place], place, np.full(len(place), size), n))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4


def _strings(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """An Arrow array of the stretches of a byte string."""
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    taken = data[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(taken)])


def _spots(texts: pa.Array, bits: np.ndarray, power: int, sizes: list[int]) -> pa.Array:
    """An Arrow array of lists of (term, n, first), one for each text."""
    data, starts = _flat(texts)
    terms, counts, firsts, lists, begin = [], [], [], [np.zeros(1, np.int64)], 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + CHUNK_BYTES, "right")) - 1)
        part, own = data[starts[begin] : starts[end]], starts[begin : end + 1] - starts[begin]
        row, at, size, n = _found(part, own, bits, power, sizes)
        order = np.argsort(row, kind="stable")
        row, at, size, n = row[order], at[order], size[order], n[order]
        chars = np.zeros(len(part) + 1, np.int64)
        np.cumsum(part & 0xC0 != 0x80, out=chars[1:])
        terms.append(_strings(part, at, size))
        counts.append(n)
        firsts.append(chars[at] - chars[own[row]])
        lists.append(lists[-1][-1] + np.cumsum(np.bincount(row, minlength=end - begin)))
        begin = end
    ends = np.concatenate(lists)
    none = np.empty(0, np.int64)
    columns = [
        pa.concat_arrays([t.cast(pa.string()) for t in terms]) if terms else pa.array([], pa.string()),
        pa.array(np.concatenate(counts or [none]), pa.int64()),
        pa.array(np.concatenate(firsts or [none]), pa.int64()),
    ]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["term", "n", "first"]))


def _filter(terms: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of whole terms and of their beginnings, and the power of its bits; no larger
    than ``FILTER_BYTES`` for any number of terms."""
    below = F.size(F.filter(F.lit(_steps(1 << 31)), lambda s: s < F.octet_length("term")))
    entries = terms.agg(F.coalesce(F.sum(1 + below), F.lit(0))).first()[0]
    power = max(15, min((FILTER_BYTES * 8).bit_length() - 1, (entries * FILTER_BITS).bit_length()))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = _flat(batch.column("term"))
            hashes, at, size = _Hashes(data), starts[:-1], np.diff(starts)
            x = [hashes.of(at, size, True)]
            for step in _steps(int(size.max(initial=0))):
                longer = size > step
                x.append(hashes.of(at[longer], step, False))
            set_ = np.unique(np.concatenate(_bits(np.unique(np.concatenate(x)), power)))
            yield pa.RecordBatch.from_arrays([pa.array(set_.astype(np.int64))], ["bit"])

    marked = terms.mapInArrow(marks, "bit long").select((F.col("bit") + 1).alias("bit"))
    pieces = marked.groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros(max(1, (1 << power) >> 3), np.uint8)
    for piece, part in pieces.toLocalIterator():
        bits[(piece - 1) << 12 : piece << 12] = np.frombuffer(part, np.uint8)
    return bits, power


def filtered_terms(text: Column, terms: DataFrame) -> Column:
    """Array of (term, n, first) like :func:`found_terms`, for a written table of distinct terms
    of any number; a few strings that are no terms are among them, which a join leaves out."""
    bits, power = _filter(terms)
    sizes = sorted(r[0] for r in terms.select(F.octet_length("term")).distinct().collect())
    held = terms.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("array<struct<term:string,n:long,first:long>>")
    def spots(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _spots(batch, held.value, power, sizes)

    return spots(text)


def located(rows: DataFrame, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """Every row once per term its text contains, with ``_term, _n, _first``, in one scan of the
    rows, without a shuffle, and with nothing kept between the batches of a stream.

    Up to ``SHARD_TERMS`` are found by an automaton.  More of them, which every worker would have
    to hold, are told from other strings by a filter of bounded size: the time follows the
    texts and what is found in them, however many terms there are.  A few rows are then of
    strings that are no terms; the caller's join with the terms leaves them out.
    """
    distinct = cut_lineage(terms.select(F.col(term).alias("term")).where("term <> ''").distinct(), "vocabulary")
    n, size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n <= SHARD_TERMS and size <= SHARD_BYTES:
        found = found_terms(F.col(text), sorted(r[0] for r in distinct.collect()))
    else:
        found = filtered_terms(F.col(text), distinct)
    one = rows.withColumn("_found", F.explode(found))
    return one.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_found.term").alias("_term"), F.col("_found.n").alias("_n"), F.col("_found.first").alias("_first"))
