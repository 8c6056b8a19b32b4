"""Dates written as reign years, cycle names or telegram day characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.functions import calendar as K
from bibliomill.functions import text as X

# One pass finds all kinds: the leftmost match wins, and no two kinds start at the same
# place.  Bracketed notes are read as tokens of their own, so nothing inside them counts;
# a mention already followed by a note is passed over, which makes annotating idempotent.
# A look at the first character spares most places the list of era names.
_ERA_FIRST = "".join(sorted({e[0] for e, _, _ in K.ERAS}))
TOKEN = (
    r"(?U)【[^】]*】"
    rf"|(?=[{_ERA_FIRST}])(?:{K.ERA_NAMES})\s*(?:{K.NUMERAL}\s*年|{K.GANZHI})(?!【)"
    rf"|{K.GANZHI}年?+(?!【)"
)
ERA_HEAD = f"^(?:{K.ERA_NAMES})"


def _overflow(era: Column, n: Column, year: Column) -> Column:
    """Doubt about a year beyond the end of its era, with the eras really in use then."""
    span = K.era_end(era) - K.era_start(era) + 1
    used = F.coalesce(X.empty_to_null(K.eras_text(year)), F.lit("（同期无内置年号）"))
    text = F.concat(
        F.lit("（存疑："), era, F.lit("共"), span.cast("string"), F.lit("年，无第"), n.cast("string"),
        F.lit("年；该年实为 "), used, F.lit("）"),
    )
    return F.when(n > span, text).otherwise("")


def read_mention(token: Column, allow_short_republic: bool = False) -> Column:
    """``struct<kind, era, n, year, years, note>`` of a token, NULL if it dates nothing."""
    none = F.lit(None)

    def out(kind: str, era: Column, n: Column, year: Column, years: Column, note: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), era.cast("string").alias("era"), n.cast("int").alias("n"),
            year.cast("int").alias("year"), years.cast("array<int>").alias("years"), note.alias("note"),
        )

    def by_number(era_n: Column, num: Column, n: Column) -> Column:
        year = K.era_start(era_n) + n - 1
        note = F.concat(era_n, num, F.lit("年="), year.cast("string"), F.lit("年"), _overflow(era_n, n, year))
        keep = n > 0
        if not allow_short_republic:
            keep = keep & ~(era_n.isin(*K.REPUBLIC) & (n < K.REPUBLIC_FROM_YEAR))
        return F.when(keep, out("era", era_n, n, year, none, note))

    def by_cycle(era_g: Column, gz_e: Column, years: Column) -> Column:
        start = K.era_start(era_g)
        inside = F.get(F.filter(years, lambda y: (y >= start - 1) & (y <= start + 70)), F.lit(0))
        nearest = F.array_min(F.transform(years, lambda y: F.struct(F.abs(y - start).alias("d"), y.alias("y"))))["y"]
        year = F.coalesce(inside, nearest)
        note = F.concat(era_g, gz_e, F.lit("="), year.cast("string"), F.lit("年"))
        return F.when(year.isNotNull(), out("era_gz", era_g, none, year, none, note))

    def bare(gz: Column, years: Column) -> Column:
        note = F.concat(gz, F.lit("="), F.array_join(years.cast("array<string>"), "、"), F.lit("年"))
        return F.when(years.isNotNull(), out("gz", none, none, none, years, note))

    def of_era(era: Column) -> Column:
        rest = X.strip(F.substring(token, F.length(era) + 1, F.length(token)))
        num = X.rstrip(F.substring(rest, F.lit(1), F.length(rest) - 1))
        return F.when(
            F.endswith(rest, F.lit("年")), X.let(K.numeral_value(num), lambda n: by_number(era, num, n))
        ).otherwise(X.let(K.ganzhi_years(rest), lambda ys: by_cycle(era, rest, ys)))

    # The first character tells the kind: no era name begins with a stem.
    head = F.substring(token, 1, 1)
    gz = F.substring(token, 1, 2)
    return F.when(F.contains(F.lit(K.STEMS), head), X.let(K.ganzhi_years(gz), lambda ys: bare(gz, ys))).when(
        head != "【", X.let(F.regexp_extract(token, ERA_HEAD, 0), of_era)
    )


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def may_date(text: Column) -> Column:
    """Cheap test that spares most texts the full pattern."""
    return F.contains(text, F.lit("年")) | F.rlike(text, F.lit(K.GANZHI))


def mentions(texts: DataFrame, key: str = "doc_id", text: str = "text", allow_short_republic: bool = False) -> DataFrame:
    """One row per date mention: ``key, pos, start, end, token, kind, era, n, year, years, note``.

    Tokens leave the scan as short rows; the offsets of one text are summed up over those.
    """
    pieces = F.split(F.col(text), TOKEN, -1)
    zipped = F.transform(
        F.arrays_zip(_tokens(F.col(text)).alias("token"), F.slice(pieces, 1, F.size(pieces) - 1).alias("piece")),
        lambda z: F.struct(z["token"].alias("token"), F.length(z["piece"]).alias("lead")),
    )
    rows = texts.filter(may_date(F.col(text))).select(key, F.posexplode(zipped).alias("pos", "_z"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("_z.token")
    end = F.sum(F.col("_z.lead") + size).over(w)
    return (
        rows.withColumn("end", end)
        .withColumn("start", F.col("end") - size)
        .select(
            key, "pos", "start", "end", F.col("_z.token").alias("token"),
            F.inline(F.array_compact(F.array(read_mention(F.col("_z.token"), allow_short_republic)))),
        )
    )


def _with_notes(text: Column, allow_short_republic: bool) -> Column:
    return F.transform(
        _tokens(text), lambda t: F.struct(t.alias("token"), read_mention(t, allow_short_republic)["note"].alias("note"))
    )


def annotated(text: Column, allow_short_republic: bool = False) -> Column:
    """The text with 【year】 after every mention."""
    parts = F.transform(
        F.arrays_zip(F.split(text, TOKEN, -1).alias("piece"), _with_notes(text, allow_short_republic).alias("hit")),
        lambda z: F.concat(
            z["piece"],
            F.coalesce(z["hit"]["token"], F.lit("")),
            F.coalesce(F.concat(F.lit("【"), z["hit"]["note"], F.lit("】")), F.lit("")),
        ),
    )
    return F.when(may_date(text), F.array_join(parts, "")).otherwise(text)


def with_note_list(text: Column, allow_short_republic: bool = False) -> Column:
    """The text followed by the list of its distinct notes in order of appearance."""
    notes = F.array_distinct(F.filter(F.transform(_with_notes(text, allow_short_republic), lambda h: h["note"]), lambda n: n.isNotNull()))
    listed = lambda ns: F.when(
        F.size(ns) > 0,
        F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\n【纪年换算】"), F.array_join(ns, "；"), F.lit("。")),
    ).otherwise(text)
    return F.when(may_date(text), X.let(notes, listed)).otherwise(text)


def timeline(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mentions and documents per year and era, with totals per year and over all (NULL)."""
    dated = found.filter("year is not null")
    by_doc = dated.groupBy("year", "era", key).agg(F.count(F.lit(1)).alias("n"))
    return by_doc.rollup("year", "era").agg(
        F.sum("n").alias("mentions"), F.count_distinct(key).alias("documents"), F.grouping_id().alias("level")
    )


# ---- telegram day characters ------------------------------------------------------------

_DAY_CHARS = "".join(sorted({r[0] for r in K.rhyme_day_rows()} - set(K.NEGATIONS)))
DAY_CODE = (
    rf"(?<![{K.NEGATIONS}])(?!{'|'.join(K.MODERN_WORDS)})([{_DAY_CHARS}])电(?![{K.NOT_FOLLOWED_BY}])"
)


def day_codes(text: Column) -> Column:
    """Day characters before 电 in order of first appearance.  Neighbours are only looked
    at, so adjacent codes do not swallow each other."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(DAY_CODE), F.lit(1)))


def day_mentions(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = texts.filter(F.contains(F.col(text), F.lit("电"))).select(key, F.posexplode(day_codes(F.col(text))).alias("pos", "char"))
    return rows.withColumn("day", K.rhyme_day(F.col("char")))


def with_day_note(text: Column, sep: str = "；") -> Column:
    """The text followed by 【代日韵目：…】, if it holds any day code."""
    entries = lambda cs: F.array_join(
        F.transform(cs, lambda c: F.concat(c, F.lit("="), K.rhyme_day(c).cast("string"), F.lit("日"))), sep
    )
    noted = lambda cs: F.when(
        F.size(cs) > 0,
        F.concat(
            text, F.when(F.endswith(text, F.lit("\n")), "").otherwise("\n"), F.lit("【代日韵目："), entries(cs), F.lit("】")
        ),
    ).otherwise(text)
    return F.when(F.contains(text, F.lit("电")), X.let(day_codes(text), noted)).otherwise(text)


def day_table(days: DataFrame) -> DataFrame:
    """One row per day: the character of each tone and the common one."""
    tones = [F.max(F.when(F.col("tone") == t, F.col("char"))).alias(f"tone_{i}") for i, t in enumerate(K.TONES, 1)]
    plain = days.filter(~F.col("char").isin(*[a for a, _ in K.SPELLINGS]))
    return plain.groupBy("day").agg(
        *tones, F.max(F.when(F.col("is_common"), F.col("char"))).alias("common"), F.count("tone").alias("chars")
    )
