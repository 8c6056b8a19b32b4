"""Licence scans.

Word k-grams of the templates are winnowed (the smallest hash of each window) into an
inverted index hash -> (template, position).  A text's own winnowed hashes look candidates
up there, and each candidate region is aligned with its template inside a band around the
diagonal the hits agree on.  Any run of ``GRAM + WINDOW - 1`` words that a text shares with a
template selects a common hash, so no such run is missed; changed words that leave
``COVERAGE`` of a long template leave a run of 4.  A template of fewer than ``SHORT`` words may keep a
run of 2 only: all its grams of ``SHORT_GRAM`` words are indexed and looked up.  Reported are the share of the
template's words that match and the span in code points.

A match is reported when it covers ``COVERAGE`` of its template, or ``LONG_MATCH`` words of a
longer one; of overlapping matches the one with more matching words stays, then the earlier
template.

Defined cases: a null or empty text has no matches; repeated rows get equal answers; a notice
that occurs several times is reported each time; an empty table gives no rows; other columns
play no part.  Texts of any length are read as a whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliomill.llm.license_texts import TEMPLATES

GRAM = 3
WINDOW = 2
SHORT = 25
SHORT_GRAM = 2
# The band is a quarter of the template, up to this many words to each side.
MOST_BAND = 12
COVERAGE = 0.8
LONG_MATCH = 25
MATCH, MISMATCH, GAP = 2, -1, -1

# ASCII letters in lower case and digits stay, bytes of other characters too; all else parts words.
TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in (ord(chr(b).lower()) if b < 128 else b for b in range(256)))
WORD = re.compile(rb"[^ ]+")


def winnow(values: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window, the last of equal ones."""
    if len(values) == 0:
        return np.empty(0, np.int64)
    if len(values) <= window:
        return np.array([len(values) - 1 - int(np.argmin(values[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(values, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


def gram_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    n = max(0, len(ids) - gram + 1)
    out = np.full(n, 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            out = (out ^ ids[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


class Index:
    def __init__(self, templates: dict[str, str], gram: int, window: int):
        self.names = list(templates)
        self.words = [t.encode().translate(TABLE).split() for t in templates.values()]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.ids = [np.array([self.number[w] for w in ws], np.int64) for ws in self.words]
        self.bands = [min(MOST_BAND, max(1, len(ids) // 4)) for ids in self.ids]
        # by gram and window: hash -> (template, position)
        self.places: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
        for t, ids in enumerate(self.ids):
            rule = (SHORT_GRAM, 1) if self.short(t) else (gram, window)
            hashes = gram_hashes(ids, rule[0])
            for at in winnow(hashes, rule[1]):
                self.places.setdefault(rule, {}).setdefault(int(hashes[at]), []).append((t, int(at)))
        self.sorted = {rule: np.array(sorted(places), np.uint64) for rule, places in self.places.items()}

    def short(self, t: int) -> bool:
        return len(self.ids[t]) < SHORT

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, place in the text, place in the template) of common selected hashes."""
        known = ids > 0
        # words no template has can begin no common run
        if not (known[:-1] & known[1:]).any():
            return []
        out = []
        for (gram, window), places in self.places.items():
            hashes, listed = gram_hashes(ids, gram), self.sorted[gram, window]
            chosen = winnow(hashes, window)
            chosen = chosen[known[chosen]]
            near = np.searchsorted(listed, hashes[chosen])
            found = chosen[listed[np.minimum(near, len(listed) - 1)] == hashes[chosen]]
            out += [(t, int(at), place) for at in found for t, place in places[int(hashes[at])]]
        return out


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment with |i - j - diagonal| <= band: matching words, first and last
    word (exclusive) of the text."""
    width = 2 * band + 1
    nothing = (0, 0, 0)  # score, matches, first word
    above = [nothing] * (width + 1)
    best = (0, 0, 0, 0)
    for j, word in enumerate(template):
        row = [nothing] * (width + 1)
        left = nothing
        for k in range(width):
            i = j + diagonal - band + k
            if i < 0 or i >= len(text):
                left = nothing
                continue
            before = above[k]
            first = before[2] if before[0] > 0 else i
            if text[i] == word:
                cell = (before[0] + MATCH, before[1] + 1, first)
            else:
                cell = (before[0] + MISMATCH, before[1], first)
            up = above[k + 1]
            if up[0] + GAP > cell[0]:
                cell = (up[0] + GAP, up[1], up[2])
            if left[0] + GAP > cell[0]:
                cell = (left[0] + GAP, left[1], left[2])
            left = row[k] = cell if cell[0] > 0 else nothing
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], i + 1)
        above = row
    return best[1], best[2], best[3]


def find(text: str | None, index: Index) -> list[tuple[str, int, int, float]]:
    """(template, start, end, coverage) of the matches of one whole text, by place."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace").translate(TABLE)
    words = raw.split(b" ") if b"  " not in raw else raw.split()
    ids = np.fromiter(map(index.number.get, words, repeat(0)), np.int64, len(words))
    if len(ids) < 3:
        return []
    hits = index.hits(ids)
    if not hits:
        return []
    if len(words) and (words[0] == b"" or words[-1] == b""):
        words = raw.split()
        ids = np.fromiter(map(index.number.get, words, repeat(0)), np.int64, len(words))
        hits = index.hits(ids)
    regions: dict[tuple[int, int], None] = {}
    for t, at, place in sorted(hits):
        # hits of one copy of a long template lie on diagonals less than a band apart; short
        # ones have chance hits beside a copy, so each diagonal is aligned for itself
        diagonal, band = at - place, 0 if index.short(t) else index.bands[t]
        if not any((t, d) in regions for d in range(diagonal - band, diagonal + band + 1)):
            regions[t, diagonal] = None
    found = []
    for t, diagonal in regions:
        band = index.bands[t]
        shift = max(0, diagonal - band)
        matches, first, end = align(ids[shift : diagonal + len(index.ids[t]) + band], index.ids[t], diagonal - shift, band)
        share = matches / len(index.ids[t])
        if share >= COVERAGE or matches >= LONG_MATCH:
            found.append((-matches, t, first + shift, end + shift, share))
    kept: list[tuple[int, int, int, float]] = []
    for _, t, first, end, share in sorted(found):
        at = bisect_left(kept, (first, -1, 0, 0.0))
        if (at == len(kept) or kept[at][0] >= end) and (at == 0 or kept[at - 1][1] <= first):
            kept.insert(at, (first, end, t, share))
    if not kept:
        return []
    spans = [m.span() for m in WORD.finditer(raw)]
    # code points before each byte
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(index.names[t], int(before[spans[first][0]]), int(before[spans[end - 1][1]]), share) for first, end, t, share in kept]


def scan(text: Column, templates: dict[str, str] | None = None) -> Column:
    """Array of (license, start, end, coverage) of a text column."""
    chosen = templates or TEMPLATES

    @F.pandas_udf("array<struct<license:string,start:bigint,end:bigint,coverage:double>>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(chosen, GRAM, WINDOW)
        for batch in batches:
            yield pd.Series([find(t, index) for t in batch])

    return scanned(text)


def license_report(docs: DataFrame) -> DataFrame:
    """Number, names, spans and coverage of the licence matches of every document."""
    found = docs.select("doc_id", scan(F.col("text")).alias("m"))
    spans = F.transform("m", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], F.format_number(x["coverage"], 3)))
    return found.select(
        "doc_id", F.size("m").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["license"]))), ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"), F.array_max(F.transform("m", lambda x: x["coverage"])).alias("best_coverage"),
    )
