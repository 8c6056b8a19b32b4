"""Script variants of a word, from a mapping table given as input."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibliomill.functions import text as X

# The four conversions, in the order in which they are tried, and how often.
CONFIGS = ("t2s", "s2t", "s2tw", "s2hk")
ROUNDS = 3


# Functions run by Python workers travel by value: no executor needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Variants:
    """Conversions built from ``(config, src, dst)`` rows.

    The table is bounded by the characters and fixed phrases of a script.  One-character
    tables become ``translate`` expressions; tables with phrases replace the longest match
    first in an Arrow function over the term dimension.
    """

    def __init__(self, table: Mapping[str, Sequence[tuple[str, str]]]):
        self.table = {c: list(table.get(c, ())) for c in CONFIGS}
        self.by_char = all(len(s) == len(d) == 1 for rows in self.table.values() for s, d in rows)

    @classmethod
    def of(cls, variant_map: DataFrame) -> Variants:
        """Reads the whole table: it is a dictionary of a script and does not grow with the corpus."""
        table: dict[str, list[tuple[str, str]]] = {}
        for r in variant_map.select("config", "src", "dst").dropDuplicates(["config", "src"]).orderBy("config", "src").collect():
            table.setdefault(r["config"], []).append((r["src"], r["dst"]))
        return cls(table)

    def convert(self, c: Column, config: str) -> Column:
        rows = self.table[config]
        if not rows:
            return c
        if self.by_char:
            return F.translate(c, "".join(s for s, _ in rows), "".join(d for _, d in rows))
        replace = _longest_match(rows)
        return F.pandas_udf(lambda s: s.map(replace, na_action="ignore"), T.StringType())(c)

    def variants(self, c: Column) -> Column:
        """All other spellings of a word in order of discovery: every conversion of every
        spelling found so far, at most three rounds."""
        if not self.by_char:
            steps = [_longest_match(self.table[k]) for k in CONFIGS]
            return F.pandas_udf(lambda s: s.map(lambda w: _closure(w, steps)), T.ArrayType(T.StringType()))(c)
        def more(found: Column) -> Column:
            return F.array_distinct(F.concat(found, F.flatten(F.transform(found, lambda w: F.array(*[self.convert(w, k) for k in CONFIGS])))))

        found = F.array(c)
        for _ in range(ROUNDS):
            # bound once: a round names the one before twice
            found = X.let(found, more)
        return F.filter(found, lambda w: (w != c) & (w != ""))

    def forms(self, c: Column) -> Column:
        """All spellings, the word included, in code-point order."""
        return F.array_sort(F.array_distinct(F.concat(F.array(c), self.variants(c))))

    def block_key(self, c: Column) -> Column:
        return F.array_min(self.forms(c))


def _longest_match(rows: Sequence[tuple[str, str]]):
    """Replacement from left to right of the longest entry that fits.  Entries are found by
    their first character and length, so the work per character does not grow with the table."""
    table = {s: d for s, d in rows if s}
    lengths: dict[str, list[int]] = {}
    for n in sorted({len(s) for s in table}, reverse=True):
        for first in {s[0] for s in table if len(s) == n}:
            lengths.setdefault(first, []).append(n)

    def replace(word: str) -> str:
        out, at = [], 0
        while at < len(word):
            for n in lengths.get(word[at], ()):
                new = table.get(word[at : at + n])
                if new is not None:
                    out.append(new)
                    at += n
                    break
            else:
                out.append(word[at])
                at += 1
        return "".join(out)

    return replace


def _closure(word: str, steps) -> list[str]:
    found = [word]
    for _ in range(ROUNDS):
        fresh = [step(w) for w in found for step in steps]
        found = list(dict.fromkeys(found + fresh))
    return [w for w in found if w and w != word]


def convert_terms(terms: DataFrame, variants: Variants, config: str, key: Sequence[str] = ("query_id",)) -> DataFrame:
    """Terms converted in order; blanks go, the first of equal results stays."""
    from bibliomill.operators.search import clean_terms

    return clean_terms(terms.withColumn("term", variants.convert(X.strip(F.col("term")), config)), key)
