"""Alias tables and the expansion of terms to all names of what they denote.

The long table is ``alias(source, source_rank, line_no, canon, pos, alias)``; each source
is a dictionary of its own, the source of rank 0 is the main one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliomill.functions import text as X
from bibliomill.functions.dims import broadcast_if_small
from bibliomill.functions.ranking import first_wins, top_per_key
from bibliomill.functions.variants import Variants
from bibliomill.operators.groups import name_lists, names_of_terms
from bibliomill.session import cut_lineage

# Fixed value: the seven separators of a dictionary line.
SEPARATORS = "[，,、；;/|]"


def parse_alias_lines(lines: DataFrame, drop_inner_blanks: bool = False) -> DataFrame:
    """One row per name after the first of each line; comments and one-name lines go."""
    line = X.strip(F.regexp_replace("line", r"^\x{FEFF}", ""))
    clean = X.compact if drop_inner_blanks else X.strip
    names = F.filter(F.transform(F.split(F.col("_l"), SEPARATORS), clean), lambda n: n != "")
    kept = (
        lines.withColumn("_l", line)
        .filter((F.col("_l") != "") & ~F.startswith("_l", F.lit("#")))
        .withColumn("_names", names)
        .filter(F.size("_names") >= 2)
    )
    rows = kept.select("source", "source_rank", "line_no", F.col("_names")[0].alias("canon"), F.posexplode("_names").alias("pos", "alias"))
    return rows.filter("pos >= 1")


def enabled_sources(alias: DataFrame, switches: DataFrame) -> DataFrame:
    """Rows of the sources not switched off; a source without a switch is on."""
    off = switches.filter("not enabled").select("source").distinct()
    return alias.join(off, "source", "left_anti")


def to_canon(alias: DataFrame) -> DataFrame:
    """Name -> canonical name per source.

    A name heading any line is its own canonical name; otherwise the first line that
    lists it decides.
    """
    heads = alias.select("source", "source_rank", F.col("canon").alias("term"), "canon", F.lit(0).alias("_k"), F.lit(0).cast("long").alias("line_no"), F.lit(0).alias("pos"))
    names = alias.filter("alias <> canon").select("source", "source_rank", F.col("alias").alias("term"), "canon", F.lit(1).alias("_k"), F.col("line_no").cast("long"), "pos")
    best = heads.unionByName(names).groupBy("source", "source_rank", "term").agg(
        F.min_by("canon", F.struct("_k", "line_no", "pos")).alias("canon")
    )
    return best


def alias_lists(alias: DataFrame) -> DataFrame:
    """Names of each canonical name per source, each once at its first place."""
    return first_wins(
        alias.filter("alias <> canon").select("source", "source_rank", "canon", "alias", F.col("line_no").cast("long").alias("line_no"), "pos"),
        ["source", "source_rank", "canon", "alias"],
        ["line_no", "pos"],
    )


def canonical(terms: DataFrame, alias: DataFrame) -> DataFrame:
    """Canonical name in the main source (the term itself if unknown) and a known flag."""
    main = to_canon(alias.filter("source_rank = 0")).select("term", F.col("canon").alias("_c"))
    return terms.join(main, "term", "left").select(
        *terms.columns, F.coalesce("_c", "term").alias("canon"), F.col("_c").isNotNull().alias("known")
    )


def _canons_per_source(forms: DataFrame, lookup: DataFrame, variants: Variants | None) -> DataFrame:
    """(term, source, source_rank, canon) through any spelling of term and canon."""
    direct = forms.join(lookup.withColumnRenamed("term", "form"), "form").select(
        "term", "source", "source_rank", "canon"
    )
    if variants is None:
        return direct
    direct = cut_lineage(direct, "direct")
    other = direct.select("term", "source", F.explode(variants.variants(F.col("canon"))).alias("form"))
    more = other.join(lookup.withColumnRenamed("term", "form"), ["source", "form"]).select(
        "term", "source", "source_rank", "canon"
    )
    return direct.unionByName(more)


def term_forms(terms: DataFrame, variants: Variants | None) -> DataFrame:
    forms = variants.forms(F.col("term")) if variants else F.array("term")
    return terms.select("term").distinct().select("term", F.explode(forms).alias("form"))


def canon_group(terms: DataFrame, alias: DataFrame, variants: Variants | None) -> DataFrame:
    """``term, source, source_rank, canon``: the entities a term may denote.

    Supplementary sources add to the main one, but replace it where the main source knows
    the term only as another entity's name.
    """
    canons = _canons_per_source(term_forms(terms, variants), cut_lineage(to_canon(alias), "lookup"), variants)
    # One row per term holds the entities it may denote; the rule is decided inside it.
    by_term = canons.groupBy("term").agg(F.collect_set(F.struct("source", "source_rank", "canon")).alias("_c"))
    main = F.filter("_c", lambda c: c["source_rank"] == 0)
    more = F.filter("_c", lambda c: c["source_rank"] > 0)
    only_more = (F.size(more) > 0) & (F.size(main) > 0) & ~F.exists(main, lambda c: c["canon"] == F.col("term"))
    kept = by_term.select("term", F.inline(F.when(only_more, more).otherwise(F.col("_c"))))
    return cut_lineage(kept, "canons")


def _group_lists(group: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members and lists of :mod:`groups` for a canon group: a block is a canonical name of
    one rank, with the sources that give it."""
    block = F.struct("source_rank", "canon", F.array_sort("_s").alias("sources")).alias("block")
    members = group.groupBy("term", "source_rank", "canon").agg(F.collect_set("source").alias("_s")).select("term", block)
    blocks = members.select("block").distinct().select("block", "block.source_rank", "block.canon", F.explode("block.sources").alias("source"))
    names = blocks.join(alias_lists(alias), ["source", "source_rank", "canon"]).select("block", F.col("alias").alias("value"), "line_no", "pos")
    return members, name_lists(first_wins(names, ["block", "value"], ["line_no", "pos"]), ["line_no", "pos"])


def _written(terms: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct terms and the alias table, written: lines are parsed once, and spellings are made
    of distinct terms only."""
    names = alias.select("source", "source_rank", "line_no", "canon", "pos", "alias")
    return cut_lineage(terms.select("term").distinct(), "terms"), cut_lineage(names, "names")


def _ordered(rows: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    w = Window.partitionBy("term").orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w).cast("long"))


def group_aliases(terms: DataFrame, alias: DataFrame, variants: Variants | None) -> DataFrame:
    """``term, alias, ord``: the names of a term's whole group in dictionary order."""
    terms, alias = _written(terms, alias)
    named = names_of_terms(*_group_lists(canon_group(terms, alias, variants), alias))
    return named.select("term", F.col("value").alias("alias"), "ord")


def blocked_terms(terms: DataFrame, blocked: DataFrame, variants: Variants | None, session: DataFrame | None = None) -> DataFrame:
    """``term, value`` pairs the user refused; lists are kept under the smallest spelling,
    so that they hold for all spellings.  Lists of the session add to the kept ones."""
    both = blocked.select("block_key", "alias")
    if session is not None:
        both = both.unionByName(session.select("block_key", "alias")).distinct()
    key = variants.block_key(F.col("term")) if variants else F.col("term")
    keyed = terms.select("term").distinct().withColumn("block_key", key)
    return keyed.join(both, "block_key").select("term", F.col("alias").alias("value")).distinct()


def related(
    terms: DataFrame,
    alias: DataFrame,
    variants: Variants | None,
    user_alias: DataFrame | None = None,
    blocked: DataFrame | None = None,
    session_blocked: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``term, value, part, ord``: the term, its spellings, canonical names, the user's own
    names and the names of its group, each once; ``limit`` cuts the group only."""
    t, alias = _written(terms, alias)
    zero, none = F.lit(0).cast("long"), F.lit("")
    group = canon_group(t, alias, variants)
    members, lists = _group_lists(group, alias)
    forms = term_forms(t, variants).select("term", F.col("form").alias("value"), F.col("form").alias("canon"))

    def part(df: DataFrame, no: int | Column, rank: Column, canon: Column, line: Column, pos: Column) -> DataFrame:
        return df.select(
            "term", "value", (no if isinstance(no, Column) else F.lit(no)).alias("part"), rank.cast("int").alias("r"), canon.alias("c"),
            line.cast("long").alias("l"), pos.cast("long").alias("p"),
        )

    c = F.col
    parts = [
        part(t.withColumn("value", c("term")), 0, zero, none, zero, zero),
        part(forms, 1, zero, c("canon"), zero, zero),
        part(group.withColumn("value", c("canon")), 2, c("source_rank"), c("canon"), zero, zero),
    ]
    if limit:
        few = names_of_terms(members, lists.where(c("at") < limit)).where(c("ord") <= limit)
        parts.append(part(few, 4, zero, none, c("ord"), zero))
    if user_alias is not None:
        own = user_alias.join(t, user_alias["word"] == t["term"]).select("term", c("alias").alias("value"), "pos")
        parts.append(part(own, 3, zero, none, zero, c("pos")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = first_wins(rows, ["term", "value"], ["part", "r", "c", "l", "p"])
    if not limit:
        rows = cut_lineage(rows, "own")
    taken = rows.select("term", "value")
    if blocked is not None:
        bad = blocked_terms(t, blocked, variants, session_blocked).filter("value <> term")
        taken = taken.unionByName(bad)
        rows = rows.join(bad, ["term", "value"], "left_anti")
    rows = _ordered(rows, ["part", "r", "c", "l", "p", "value"]).select("term", "value", "part", "ord")
    if limit:
        return rows
    rows = cut_lineage(rows, "numbered")
    # the names of a whole group follow what is the term's own
    start = rows.groupBy("term").agg(F.count(F.lit(1)).alias("start"))
    named = names_of_terms(members, lists, taken, start)
    return rows.unionByName(named.select("term", "value", F.lit(4).alias("part"), "ord"))


def expand(
    terms: DataFrame,
    alias: DataFrame,
    variants: Variants,
    user_alias: DataFrame | None = None,
    blocked: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Expansion by the switches ``use_variant`` and ``use_alias`` of each term.

    Neither: the term alone.  Variants only: spellings in order of discovery.  Aliases:
    :func:`related`, across spellings only where variants are on.
    """
    both = related(terms.filter("use_alias and use_variant"), alias, variants, user_alias, blocked, None, limit)
    names = related(terms.filter("use_alias and not use_variant"), alias, None, user_alias, None, None, limit)
    if blocked is not None:
        bad = blocked_terms(terms, blocked, variants).filter("value <> term")
        names = names.join(bad, ["term", "value"], "left_anti")
        names = _ordered(names.withColumnRenamed("ord", "_o"), ["_o"]).drop("_o")
    plain = terms.filter("not use_alias").select("term", "use_variant").distinct()
    spelled = F.when(F.col("use_variant"), F.concat(F.array("term"), variants.variants(F.col("term")))).otherwise(F.array("term"))
    only = plain.select("term", F.posexplode(spelled).alias("_o", "value"))
    if blocked is not None:
        only = only.join(bad, ["term", "value"], "left_anti")
    only = _ordered(only, ["_o"]).select("term", "value", F.lit(1).alias("part"), "ord")
    return both.unionByName(names).unionByName(only.select("term", "value", "part", "ord"))


# ---- lists kept by the user --------------------------------------------------------


def upsert_lists(current: DataFrame, changes: DataFrame, key: str = "word") -> DataFrame:
    """Replace whole lists: a word in ``changes`` gets the list given there, a list without
    any name deletes the word."""
    kept = current.join(changes.select(key).distinct(), key, "left_anti")
    fresh = changes.withColumn("alias", X.strip(F.col("alias"))).filter("alias is not null and alias <> ''")
    return kept.unionByName(fresh.select(*current.columns))


# ---- many-to-many dictionary --------------------------------------------------------


def merge_layers(alias: DataFrame) -> DataFrame:
    """All sources as one dictionary; lower layers come first, nothing is removed."""
    return first_wins(
        alias.filter("alias <> canon").select("canon", "alias", "source_rank", F.col("line_no").cast("long").alias("line_no"), "pos"),
        ["canon", "alias"],
        ["source_rank", "line_no", "pos"],
    )


def lookup_all(terms: DataFrame, merged: DataFrame) -> DataFrame:
    """Every canonical name a term may stand for, with the other names of each."""
    merged = cut_lineage(merged, "merged")
    heads = merged.select(F.col("canon").alias("term"), "canon")
    index = heads.unionByName(merged.select(F.col("alias").alias("term"), "canon")).distinct()
    found = terms.select("term").distinct().join(index, "term").select("term", F.col("canon").alias("block"))
    place = ["source_rank", "line_no", "pos"]
    lists = name_lists(merged.select(F.col("canon").alias("block"), F.struct("alias", *place).alias("value"), *place), place)
    named = names_of_terms(found, lists, once=False)
    return named.select("term", F.col("block").alias("canon"), "value.*").filter("alias <> term")


def canonical_all(terms: DataFrame, merged: DataFrame) -> DataFrame:
    heads = merged.select(F.col("canon").alias("term"), "canon")
    index = heads.unionByName(merged.select(F.col("alias").alias("term"), "canon")).distinct()
    return terms.select("term").distinct().join(index, "term").groupBy("term").agg(
        F.min("canon").alias("canon"), F.count(F.lit(1)).alias("people")
    )


def expand_all(terms: DataFrame, merged: DataFrame, limit: int | None = None) -> DataFrame:
    """Other names to search along, over all people of that name; with ``limit`` the first so
    many of each term, numbered.

    People come by canonical name, and each brings that name at least, so the first ``limit``
    names are told by ``limit + 1`` people of a term (one may be called by the term itself) and
    by ``limit + 1`` names of each.  Both tables are cut to that before they are joined: a name
    of any number of people, or a person of any number of names, pairs no more than that.
    """
    if limit is None:
        merged = cut_lineage(merged, "merged")
    heads = merged.select(F.col("canon").alias("term"), "canon")
    index = heads.unionByName(merged.select(F.col("alias").alias("term"), "canon")).distinct()
    if limit is None:
        found = terms.select("term").distinct().join(index, "term").select("term", F.col("canon").alias("block"))
        place = ["source_rank", "line_no", "pos"]
        names = merged.select(F.col("canon").alias("block"), F.col("alias").alias("value"), *place)
        own = heads.distinct().select(
            F.col("canon").alias("block"), F.col("canon").alias("value"), F.lit(-1).alias("source_rank"), F.lit(0).cast("long").alias("line_no"), F.lit(0).alias("pos")
        )
        itself = terms.select("term", F.col("term").alias("value"))
        return names_of_terms(found, name_lists(own.unionByName(names), place), itself).select("term", "value")
    index = top_per_key(index, ["term"], [F.col("canon")], limit + 1).drop("rank")
    merged = top_per_key(merged, ["canon"], [F.col(c) for c in ("source_rank", "line_no", "pos", "alias")], limit + 1).drop("rank")
    found = terms.select("term").distinct().join(index, "term")
    own = found.select("term", F.col("canon").alias("value"), "canon", F.lit(0).alias("r"), F.lit(0).cast("long").alias("l"), F.lit(0).alias("p"))
    names = found.join(merged, "canon").select("term", F.col("alias").alias("value"), "canon", (F.col("source_rank") + 1).alias("r"), F.col("line_no").alias("l"), F.col("pos").alias("p"))
    rows = first_wins(own.unionByName(names).filter("value <> term"), ["term", "value"], ["canon", "r", "l", "p"])
    order = [F.col(c) for c in ("canon", "r", "l", "p", "value")]
    return top_per_key(rows, ["term"], order, limit, "ord").select("term", "value", F.col("ord").cast("long").alias("ord"))


def import_counts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many people and names an import adds."""
    new_people = incoming.select("canon").distinct().join(current.select("canon").distinct(), "canon", "left_anti")
    pairs = incoming.filter("alias <> canon").select("canon", "alias").distinct()
    new_names = pairs.join(current.select("canon", "alias"), ["canon", "alias"], "left_anti")
    both = new_people.select(F.lit(True).alias("person")).unionByName(new_names.select(F.lit(False).alias("person")))
    return both.agg(
        F.count_if(F.col("person")).alias("new_people"), F.count_if(~F.col("person")).alias("new_names")
    )


def replace_people(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adding a person replaces the names held so far."""
    return current.join(incoming.select("canon").distinct(), "canon", "left_anti").unionByName(incoming)


def remove_people(current: DataFrame, gone: DataFrame) -> DataFrame:
    return current.join(gone.select("canon").distinct(), "canon", "left_anti")


def dictionary_counts(merged: DataFrame) -> DataFrame:
    by = merged.groupBy("canon").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.count(F.lit(1)).alias("people"), F.sum("n").alias("names"))


def dictionary_lines(merged: DataFrame) -> DataFrame:
    """Export lines sorted by canonical name."""
    ordered = F.array_sort(F.collect_list(F.struct("source_rank", "line_no", "pos", "alias")))
    by = merged.groupBy("canon").agg(F.transform(ordered, lambda s: s["alias"]).alias("_a"))
    return by.select("canon", F.concat_ws(",", "canon", F.array_join("_a", ",")).alias("line")).orderBy("canon")


def people_from_biographies(
    main: DataFrame, alternative: DataFrame, min_len: int = 2, max_aliases: int | None = None,
    year_from: int | None = None, year_to: int | None = None,
) -> DataFrame:
    """``canon, alias`` from ``main(person_id, name, year)`` and
    ``alternative(person_id, alt_name, seq)``; people of the same name are united.  With
    ``max_aliases`` only so many names of a person, by ``seq``."""
    people = main.filter("name is not null and name <> ''").select("person_id", X.strip(F.col("name")).alias("canon"), "year")
    if year_from:
        people = people.filter(F.col("year") >= year_from)
    if year_to:
        people = people.filter(F.col("year") <= year_to)
    names = alternative.withColumn("alias", X.strip(F.col("alt_name"))).filter(
        X.is_cjk_name(F.col("alias")) & (F.length("alias") >= min_len)
    )
    rows = people.join(names, "person_id").filter("alias <> canon")
    rows = first_wins(rows.select("person_id", "alias", "seq", "canon"), ["person_id", "alias"], ["seq"])
    rows = top_per_key(rows, ["person_id"], [F.col("seq"), F.col("alias")], max_aliases)
    return rows.select("canon", "alias").distinct()


# ---- use and upkeep -------------------------------------------------------------------


def entity_counts(hits: DataFrame, lookup: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents and mentions per canonical name, whatever name was hit."""
    named = hits.select("term", key, "count").join(broadcast_if_small(lookup.select("term", "canon")), "term")
    per_doc = named.groupBy("canon", key).agg(F.sum("count").alias("n"))
    return per_doc.groupBy("canon").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("mentions"))


def shadow_variants(terms: DataFrame, seeds: DataFrame, variants: Variants, blocked: DataFrame | None = None) -> DataFrame:
    """Spellings added next to their source term: ``query_id, value, source_term``.

    The first claim on a spelling holds; a spelling that already serves as a source, the
    main word, and refused spellings are never claimed.  Dropping a source from ``terms``
    drops its shadows.
    """
    src = terms.select("query_id", "term", F.col("pos").cast("long").alias("pos")).unionByName(
        seeds.select("query_id", F.col("seed").alias("term"), F.lit(-1).cast("long").alias("pos"))
    )
    pairs = src.select("query_id", "pos", F.col("term").alias("source_term"), F.posexplode(variants.variants(F.col("term"))).alias("v_pos", "value"))
    pairs = pairs.join(seeds, "query_id", "left").filter("seed is null or value <> seed")
    if blocked is not None:
        key = seeds.select("query_id", variants.block_key(F.col("seed")).alias("block_key"))
        bad = key.join(blocked, "block_key").select("query_id", F.col("alias").alias("value"))
        pairs = pairs.join(bad, ["query_id", "value"], "left_anti")
    first = first_wins(pairs.select("query_id", "value", "pos", "v_pos", "source_term"), ["query_id", "value"], ["pos", "v_pos"])
    used = first.groupBy("query_id", F.col("source_term").alias("value")).agg(F.min("pos").alias("_used"))
    kept = first.join(used, ["query_id", "value"], "left").filter("_used is null or _used > pos")
    return kept.select("query_id", "value", "source_term", "pos")


def audit(extra: DataFrame, main: DataFrame, variants: Variants) -> DataFrame:
    """Findings ``rule, source, canon, detail`` on supplementary sources.

    Rules: ``repeated_canon``, ``one_char``, ``repeated_in_group``, ``redundant``,
    ``addition`` (a name the main source lacks), ``other_owner``, ``spelling_only``.  Names,
    owners and additions are used by several rules and written once; the spellings of a name
    are looked up once for each owner.
    """
    line = ["source", "source_rank", "line_no", "canon"]
    extra = cut_lineage(extra.select(*line, "alias"), "audited")
    groups = extra.select(*line).distinct()
    again = first_wins(groups.select("canon", "source_rank", "line_no", "source"), ["canon"], ["source_rank", "line_no"])
    repeated = groups.join(again, ["canon", "source_rank", "line_no"], "left_anti").select(
        F.lit("repeated_canon").alias("rule"), "source", "canon", F.lit("").alias("detail")
    )
    one = extra.filter(F.length("alias") == 1).select(F.lit("one_char").alias("rule"), "source", "canon", F.col("alias").alias("detail"))
    twice = extra.groupBy(*line, "alias").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or alias = canon")
    twice = twice.select(F.lit("repeated_in_group").alias("rule"), "source", "canon", F.col("alias").alias("detail"))

    lookup = to_canon(main).select(F.col("term").alias("form"), F.col("canon").alias("owner"))
    words = extra.select(F.col("canon").alias("w")).union(extra.select("alias")).distinct()
    owners = cut_lineage(
        words.select("w", F.explode(variants.forms(F.col("w"))).alias("form"))
        .join(lookup, "form")
        .groupBy("w")
        .agg(F.min_by("owner", "form").alias("owner")),
        "owners",
    )
    have = alias_lists(main).select(F.col("canon").alias("owner"), F.explode(variants.forms(F.col("alias"))).alias("form")).distinct()
    owned = groups.join(owners.withColumnRenamed("w", "canon"), "canon")
    named = owned.join(extra.select(*line, "alias").distinct(), line)
    spelled = named.select("owner", "alias").distinct().select("owner", "alias", F.explode(variants.forms(F.col("alias"))).alias("form"))
    covered = spelled.join(have, ["owner", "form"], "left_semi").select("owner", "alias").distinct()
    new = cut_lineage(named.join(covered, ["owner", "alias"], "left_anti"), "additions")
    addition = new.select(F.lit("addition").alias("rule"), "source", "canon", F.col("alias").alias("detail"))
    redundant = owned.join(new, line, "left_anti").select(F.lit("redundant").alias("rule"), "source", "canon", F.col("owner").alias("detail"))

    other = (
        extra.select(*line, "alias").distinct()
        .join(owners.select(F.col("w").alias("alias"), F.col("owner").alias("oa")), "alias")
        .join(owners.select(F.col("w").alias("canon"), "owner"), "canon", "left")
        .filter("oa <> canon and (owner is null or owner <> oa)")
        .select(F.lit("other_owner").alias("rule"), "source", "canon", F.col("alias").alias("detail"))
    )
    spelling = extra.filter(F.array_contains(variants.forms(F.col("canon")), F.col("alias"))).select(
        F.lit("spelling_only").alias("rule"), "source", "canon", F.col("alias").alias("detail")
    )
    out = repeated
    for rule in (one, twice, addition, redundant, other, spelling):
        out = out.unionByName(rule)
    return out
