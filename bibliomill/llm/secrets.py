"""Secret scans through a trigram inverted index.

From each rule's expression follows a Boolean query over trigrams that every match must
contain.  The index has a posting (trigram, document) for each trigram some rule asks for;
postings are intersected per document, and only documents that satisfy a rule's query are
verified with its expression.  A rule without mandatory trigrams, such as a run of
hexadecimal digits, scans every text.  The index holds lower-case trigrams, so it serves
rules with and without regard to case; it may name too many documents, never too few.

Only DataFrame functions run on the executors.  The queries are derived on the driver, from
the parse tree of the expression, once per rule.

Defined cases: a null text is empty and has no spans; repeated rows, and rows that share an
id, each get the spans of their own text; spans of different rules may overlap, and equal
starts follow the order of the rules; an empty table gives no rows; other columns play no
part.  Texts of any length are read as a whole.  Offsets count code points.
"""

from __future__ import annotations

import re._constants as ast
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliomill.llm.common import broadcast_up_to, cut_lineage, free_name

# Choices of a class or of alternatives that are still followed one by one.
MOST_CHOICES = 64
# Candidates of this many documents are sent to all executors; more are joined by shuffling.
BROADCAST_IDS = 500_000
MASK_BITS = 62


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression (valid for Python and Java alike), the group whose
    length counts, and the length it needs."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The first three are fixed by contract; the others are published token formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")

# ---- Boolean trigram queries -------------------------------------------------------

Query = frozenset  # of frozensets of trigrams: any of these sets must be there in full


def _simplest(options) -> Query | None:
    """Drop every set that contains another one; None if one of them asks for nothing."""
    options = set(options)
    if frozenset() in options:
        return None
    return Query(o for o in options if not any(p < o for p in options))


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return a or b
    return _simplest(x | y for x in a for y in b)


def _of_strings(strings: set[str]) -> Query | None:
    return _simplest(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is ast.LITERAL:
            out.add(chr(value).lower())
        elif op is ast.RANGE and value[1] - value[0] < MOST_CHOICES:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def _walk(tree) -> tuple[set[str] | None, Query | None]:
    """The strings an expression can match, if they are few, else the query its matches satisfy."""
    query: Query | None = None
    run: set[str] = {""}

    def close() -> None:
        nonlocal query, run
        query, run = _both(query, _of_strings(run)), {""}

    open_ended = False
    for op, value in tree:
        strings: set[str] | None = None
        inner: Query | None = None
        if op is ast.LITERAL:
            strings = {chr(value).lower()}
        elif op is ast.IN:
            strings = _class(value)
            if strings is not None and len(strings) > 8:
                strings = None
        elif op is ast.SUBPATTERN:
            strings, inner = _walk(value[3])
        elif op is ast.BRANCH:
            parts = [_walk(v) for v in value[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                queries = [_of_strings(s) if s is not None else q for s, q in parts]
                inner = None if None in queries else _simplest(set().union(*queries))
        elif op in (ast.MAX_REPEAT, ast.MIN_REPEAT):
            low, high, body = value
            strings, inner = _walk(body)
            if strings is not None and (low, high) == (0, 1):
                strings = strings | {""}
            elif strings is not None and low == high == 1:
                pass
            elif low == 0:
                strings, inner = None, None
            elif strings is not None and len(strings) ** low <= MOST_CHOICES:
                must = reduce(lambda a, b: {x + y for x in a for y in b}, [strings] * low, {""})
                if len(run) * len(must) > MOST_CHOICES:
                    close()
                    open_ended = True
                run = {x + y for x in run for y in must}
                if high != low:
                    close()
                    open_ended = True
                continue
            else:
                strings = None
        if strings is not None and len(run) * len(strings) <= MOST_CHOICES:
            run = {x + y for x in run for y in strings}
        else:
            close()
            open_ended = True
            query = _both(query, inner if strings is None else _of_strings(strings))
    if not open_ended:
        return run, None
    close()
    return None, query


def trigram_query(pattern: str) -> Query | None:
    """Sets of lower-case trigrams of which every match holds at least one set; None if the
    expression has no mandatory trigram."""
    strings, query = _walk(parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


# ---- the index ---------------------------------------------------------------------


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for option in trigram_query(r.pattern) or () for t in option})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram number, doc_id) for every trigram of the rules in every text."""
    lower = docs.select("doc_id", F.lower("text").alias("low"))
    present = [F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary(rules))]
    return lower.select("doc_id", F.explode(F.array_compact(F.array(*present))).alias("trigram")) if present else lower.limit(0).selectExpr("doc_id", "0 AS trigram")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): documents whose postings satisfy the query of a rule, and a bit for
    each such rule."""
    number = {t: i for i, t in enumerate(vocabulary(rules))}
    words = range(-(-len(number) // MASK_BITS))
    bit = F.expr(f"shiftleft(1L, CAST(trigram % {MASK_BITS} AS INT))")
    masks = [F.bit_or(F.when(F.floor(F.col("trigram") / MASK_BITS) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"mask{w}") for w in words]
    found = index.groupBy("doc_id").agg(*masks) if masks else index.select("doc_id").distinct()

    def holds(option) -> Column:
        needs = [sum(1 << number[t] % MASK_BITS for t in option if number[t] // MASK_BITS == w) for w in words]
        return reduce(Column.__and__, [F.col(f"mask{w}").bitwiseAND(F.lit(n)) == n for w, n in enumerate(needs) if n])

    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query is not None:
            satisfied = reduce(Column.__or__, [holds(option) for option in sorted(query, key=sorted)])
            bits = bits.bitwiseOR(F.when(satisfied, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return found.select("doc_id", bits.alias("rules")).where("rules <> 0")


# ---- verification --------------------------------------------------------------------


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of a rule's leftmost matches that do not overlap.

    The text between the matches and the matches in turn give the offsets.  A run with a
    least length is looked for with that length, which finds the same runs sooner.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    between = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("match"), counted.alias("part"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    return F.when(F.size(matches) > 0, F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]).otherwise(none)


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """``docs`` with the sorted spans of all rules in a new column, and its name."""
    found = cut_lineage(candidates(cut_lineage(postings(docs, rules), "postings"), rules), "candidates")
    ids, bits, spans = free_name(docs, "candidate_id"), free_name(docs, "candidate_rules"), free_name(docs, "spans")
    few = broadcast_up_to(found.select(F.col("doc_id").alias(ids), F.col("rules").alias(bits)), BROADCAST_IDS)
    marked = docs.join(few, F.col("doc_id").eqNullSafe(F.col(ids)), "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        if trigram_query(rule.pattern) is not None:
            asked = F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
            parts.append(F.when(asked, rule_spans(F.col("text"), rule, i)).otherwise(none))
        else:
            # a full scan; the length a match needs is part of the expression it looks for
            sure = _with_least(rule)
            parts.append(F.when(F.rlike(F.col("text"), F.lit(sure.pattern)), rule_spans(F.col("text"), sure, i)).otherwise(none))
    return marked.withColumn(spans, F.array_sort(F.concat(*parts))).drop(ids, bits), spans


def _with_least(rule: Rule) -> Rule:
    """The same rule with its least length inside the expression, where that is a repeated
    class: maximal runs of at least n are the maximal runs that have n characters."""
    tree = parser.parse(rule.pattern)
    if len(tree) == 1 and tree[0][0] is ast.MAX_REPEAT and rule.pattern.endswith("]+"):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", rule.group, rule.least)
    return rule


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    found, spans = with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rules)
    base = {r.kind: i for i, r in enumerate(rules) if r.kind in BASE_KINDS}
    of_base = F.filter(spans, lambda s: s["order"].isin(list(base.values())))

    def number(order: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["order"] == order)).cast("long")

    counts = [number(i).alias(f"n_{k}") for k, i in base.items()]
    return found.select("doc_id", *counts, F.sha2(_joined(of_base, rules), 256).alias("base_sha256"), _joined(F.col(spans), rules).alias("spans"))


def without_secrets(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every span replaced by ``mask``; overlapping spans become one.
    Texts without spans stay as they are, and all columns keep their names."""
    found, spans = with_spans(docs, rules)
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        after = s["start"] >= acc["at"]
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(after, gap).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rest = F.expr(f"substring(text, {free_name(found, 'done')}.at + 1)")
    name = free_name(found, "done")
    masked = found.withColumn(name, F.when(F.size(spans) > 0, done))
    new = F.when(F.col(name).isNull(), text).otherwise(F.concat(F.col(f"{name}.out"), rest))
    out = []
    for c in docs.columns:
        if c.lower() == "text":
            out.append(new.alias(c))
        elif c.lower() == "n_chars":
            out.append(F.when(F.col(name).isNull(), F.col(f"`{c}`")).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return masked.select(*out)


# DuckDB: each kind's matches and what lies between them, found in every text.
SECRETS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k(ord, kind, pat, grp, least) AS (VALUES """ + ", ".join(
    "({}, '{}', '{}', {}, {})".format(i, r.kind, _with_least(r).pattern.replace("'", "''"), r.group, r.least) for i, r in enumerate(RULES)
) + """),
m AS (""" + " UNION ALL ".join(
    "SELECT doc_id, {i} AS ord, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {g}) AS gs, string_split_regex(t, '{p}') AS ps "
    "FROM d WHERE regexp_matches(t, '{p}')".format(i=i, p=_with_least(r).pattern.replace("'", "''"), g=r.group) for i, r in enumerate(RULES)
) + """),
u AS (SELECT doc_id, ord, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT u.doc_id, u.ord, k.kind,
        list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start_,
        length(ms[i]) AS len, length(gs[i]) AS counted, k.least
      FROM u JOIN k USING (ord)),
f AS (SELECT doc_id, ord, kind, start_, kind || ':' || start_ || ':' || (start_ + len) AS span FROM s WHERE counted >= least),
a AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
        string_agg(span, ',' ORDER BY start_, ord) FILTER (WHERE ord < 3) AS base, string_agg(span, ',' ORDER BY start_, ord) AS spans
      FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
