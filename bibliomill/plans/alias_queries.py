"""Variant, alias and expansion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliomill.functions.variants import CONFIGS, Variants, convert_terms
from bibliomill.operators import aliases as A
from bibliomill.operators import search as S
import bibliomill.plans.inputs  # noqa: F401  the derived inputs
from bibliomill.plans.registry import Tables, oracle, query
from bibliomill.plans.search_queries import PAGES_SQL, doc_pages
from bibliomill.session import cut_lineage

# A small variant table over Latin letters; it converts both ways and in two steps.
VARIANT_ROWS = [
    ("t2s", "é", "e"), ("t2s", "è", "e"), ("t2s", "ç", "c"), ("t2s", "ó", "o"), ("t2s", "ä", "a"),
    ("s2t", "e", "é"), ("s2t", "c", "ç"), ("s2t", "ó", "ö"),
    ("s2tw", "e", "è"), ("s2tw", "ä", "å"),
    ("s2hk", "a", "ä"),
]


def variants(t: Tables) -> Variants:
    return Variants.of(t.spark.createDataFrame(VARIANT_ROWS, "config string, src string, dst string"))


def conv(x: str, config: str) -> str:
    pairs = [(s, d) for c, s, d in VARIANT_ROWS if c == config]
    return f"translate({x}, '{''.join(s for s, _ in pairs)}', '{''.join(d for _, d in pairs)}')"


def _round(l: str) -> str:
    four = ", ".join(conv("x", c) for c in CONFIGS)
    return f"list_concat({l}, flatten(list_transform({l}, lambda x: [{four}])))"


def _once(l: str) -> str:
    return f"list_filter({l}, lambda y, i: list_position({l}, y) = i)"


def variants_sql(words: str) -> str:
    """``w, vs``: the spellings of every word of a one-column query ``w``."""
    q = f"SELECT w, [w] AS r FROM ({words})"
    for _ in range(3):
        q = f"SELECT w, {_once('r')} AS r FROM (SELECT w, {_round('r')} AS r FROM ({q}))"
    return f"SELECT w, list_filter(r, lambda v: v <> w AND v <> '') AS vs FROM ({q})"


CTES = dict(
    parsed="""
SELECT source, source_rank, line_no, list_filter(list_transform(regexp_split_to_array(line, '[，,、；;/|]'), lambda s: trim(s)), lambda s: s <> '') AS names
FROM {v_alias_lines} WHERE NOT starts_with(trim(line), '#')""",
    al="""
SELECT source, source_rank, line_no, names[1] AS canon, unnest(range(1, len(names))) AS pos, unnest(names[2:]) AS alias FROM parsed WHERE len(names) >= 2""",
    heads="SELECT DISTINCT source, source_rank, canon AS term, canon FROM al",
    tc="""
SELECT * FROM heads UNION ALL
SELECT source, source_rank, alias, arg_min(canon, line_no * 100 + pos) FROM al
WHERE alias <> canon AND (source, alias) NOT IN (SELECT (source, term) FROM heads) GROUP BY source, source_rank, alias""",
    lists="SELECT source, source_rank, canon, alias, min(line_no * 100 + pos) AS lp FROM al WHERE alias <> canon GROUP BY ALL",
    words="SELECT DISTINCT w FROM (SELECT term AS w FROM {v_alias_terms} UNION ALL SELECT canon FROM al UNION ALL SELECT alias FROM al)",
    vr=variants_sql("SELECT w FROM words"),
    fm="SELECT w AS term, unnest(list_append(vs, w)) AS form FROM vr",
    tf="SELECT * FROM fm WHERE term IN (SELECT term FROM {v_alias_terms})",
    cg1="SELECT DISTINCT tf.term, tc.source, tc.source_rank, tc.canon FROM tf JOIN tc ON tc.term = tf.form",
    cg="""
SELECT * FROM cg1 UNION
SELECT c.term, tc.source, tc.source_rank, tc.canon FROM (SELECT cg1.*, unnest(vr.vs) AS v FROM cg1 JOIN vr ON vr.w = cg1.canon) c
JOIN tc ON tc.source = c.source AND tc.term = c.v""",
    fl="""
SELECT term, count(*) FILTER (WHERE source_rank > 0) > 0 AND count(*) FILTER (WHERE source_rank = 0) > 0
  AND count(*) FILTER (WHERE source_rank = 0 AND canon = term) = 0 AS only_more FROM cg GROUP BY term""",
    kp="SELECT cg.* FROM cg JOIN fl USING (term) WHERE NOT only_more OR source_rank > 0",
    gn="""
SELECT term, alias AS value, source_rank, canon, lp FROM (
  SELECT kp.term, l.alias, kp.source_rank, kp.canon, l.lp, row_number() OVER (PARTITION BY kp.term, l.alias ORDER BY kp.source_rank, kp.canon, l.lp) AS rn
  FROM kp JOIN lists l ON l.source = kp.source AND l.canon = kp.canon) WHERE rn = 1""",
    hd="SELECT term, canon AS value, min(source_rank) AS source_rank FROM kp GROUP BY ALL",
)


def related_sql(group: str = "gn", blocked: bool = True) -> str:
    anti = (
        """WHERE NOT EXISTS (SELECT 1 FROM {v_blocked} b JOIN (SELECT term, min(form) AS k FROM tf GROUP BY term) bk ON bk.k = b.block_key
        WHERE bk.term = u.term AND b.alias = u.value AND u.value <> u.term)"""
        if blocked
        else ""
    )
    return f"""
SELECT term, value, part, row_number() OVER (PARTITION BY term ORDER BY part, r, c, lp, value) AS ord FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term, value ORDER BY part, r, c, lp) AS rn FROM (
    SELECT term, term AS value, 0 AS part, 0 AS r, '' AS c, 0 AS lp FROM {{v_alias_terms}}
    UNION ALL SELECT term, form, 1, 0, form, 0 FROM tf
    UNION ALL SELECT term, value, 2, source_rank, value, 0 FROM hd
    UNION ALL SELECT t.term, u.alias, 3, 0, '', u.pos FROM {{v_alias_terms}} t JOIN {{v_user_alias}} u ON u.word = t.term
    UNION ALL SELECT term, value, 4, source_rank, canon, lp FROM {group})) WHERE rn = 1) u
{anti}"""


def alias_oracle(select: str, **more: str) -> str:
    return oracle(select, **CTES, **more)


def alias(t: Tables) -> DataFrame:
    return A.parse_alias_lines(t.v_alias_lines)


@query(
    "src_04_alias_lines",
    alias_oracle("SELECT source, CAST(line_no AS BIGINT) AS line_no, canon, CAST(pos AS BIGINT) AS pos, alias FROM al"),
)
def _alias_lines(t: Tables) -> DataFrame:
    return alias(t).select("source", "line_no", "canon", F.col("pos").cast("long").alias("pos"), "alias")


CONVERTED = "SELECT query_id, min(pos) AS pos, term FROM (SELECT doc_id % 50 AS query_id, doc_id * 100000 + i AS pos, {c} AS term FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}]+') AS ws FROM documents))) GROUP BY 1, 3"


@query(
    "var_01_converted_terms",
    oracle(
        "SELECT query_id, term, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS BIGINT) AS pos FROM c",
        c=CONVERTED.format(c=conv("w", "t2s")),
    ),
)
def _converted(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("i", "term")).select(
        (F.col("doc_id") % 50).alias("query_id"), (F.col("doc_id") * 100000 + F.col("i")).alias("pos"), "term"
    )
    return convert_terms(words, variants(t), "t2s").select("query_id", "term", "pos")


@query(
    "var_02_spellings",
    alias_oracle("SELECT w AS term, unnest(vs) AS spelling, CAST(unnest(range(1, len(vs) + 1)) AS BIGINT) AS pos FROM vr"),
)
def _spellings(t: Tables) -> DataFrame:
    a = alias(t)
    words = t.v_alias_terms.union(a.select("canon")).union(a.select("alias")).distinct()
    v = words.select("term", F.posexplode(variants(t).variants(F.col("term"))).alias("p", "spelling"))
    return v.select("term", "spelling", (F.col("p") + 1).cast("long").alias("pos"))


@query(
    "var_03_forms_and_block_key",
    alias_oracle("SELECT term, string_agg(form, ',' ORDER BY form) AS forms, min(form) AS block_key FROM tf GROUP BY term"),
)
def _forms(t: Tables) -> DataFrame:
    v = variants(t)
    return t.v_alias_terms.select(
        "term", F.array_join(v.forms(F.col("term")), ",").alias("forms"), v.block_key(F.col("term")).alias("block_key")
    )


@query("ali_01_to_canon", alias_oracle("SELECT source, term, canon FROM tc"))
def _to_canon(t: Tables) -> DataFrame:
    return A.to_canon(alias(t)).select("source", "term", "canon")


@query(
    "ali_01_alias_lists",
    alias_oracle("SELECT source, canon, alias, CAST(lp AS BIGINT) AS lp FROM lists"),
)
def _alias_lists(t: Tables) -> DataFrame:
    return A.alias_lists(alias(t)).select(
        "source", "canon", "alias", (F.col("line_no") * 100 + F.col("pos")).cast("long").alias("lp")
    )


@query(
    "ali_02_canonical",
    alias_oracle(
        "SELECT t.term, coalesce(c.canon, t.term) AS canon, c.canon IS NOT NULL AS known FROM {v_alias_terms} t LEFT JOIN (SELECT * FROM tc WHERE source = 'main') c USING (term)"
    ),
)
def _canonical(t: Tables) -> DataFrame:
    return A.canonical(t.v_alias_terms, alias(t))


@query(
    "ali_03_group_of_main",
    alias_oracle(
        """SELECT term, alias, row_number() OVER (PARTITION BY term ORDER BY canon, lp) AS ord FROM (
        SELECT cg.term, l.alias, cg.canon, l.lp, row_number() OVER (PARTITION BY cg.term, l.alias ORDER BY cg.canon, l.lp) AS rn
        FROM cg JOIN lists l ON l.source = cg.source AND l.canon = cg.canon WHERE cg.source = 'main') WHERE rn = 1"""
    ),
)
def _group_main(t: Tables) -> DataFrame:
    return A.group_aliases(t.v_alias_terms, alias(t).filter("source_rank = 0"), variants(t))


@query(
    "ali_04_group_with_supplements",
    alias_oracle(
        "SELECT term, value AS alias, row_number() OVER (PARTITION BY term ORDER BY source_rank, canon, lp) AS ord FROM gn"
    ),
)
def _group_all(t: Tables) -> DataFrame:
    return A.group_aliases(t.v_alias_terms, alias(t), variants(t))


@query("ali_05_related", alias_oracle("SELECT term, value, CAST(part AS BIGINT) AS part, ord FROM (" + related_sql() + ")"))
def _related(t: Tables) -> DataFrame:
    r = A.related(t.v_alias_terms, alias(t), variants(t), t.v_user_alias, t.v_blocked)
    return r.select("term", "value", F.col("part").cast("long").alias("part"), "ord")


@query(
    "ali_05_related_limited",
    alias_oracle(
        "SELECT term, value, ord FROM (" + related_sql("gl", blocked=False) + ")",
        gl="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY source_rank, canon, lp) AS k FROM gn) WHERE k <= 3",
    ),
)
def _related_limited(t: Tables) -> DataFrame:
    r = A.related(t.v_alias_terms, alias(t), variants(t), t.v_user_alias, None, None, 3)
    return r.select("term", "value", "ord")


@query(
    "ali_06_expand",
    alias_oracle(
        """
SELECT term, value, ord FROM re WHERE length(term) % 3 = 0
UNION ALL SELECT term, term, 1 FROM {v_alias_terms} WHERE length(term) % 3 = 1
UNION ALL SELECT term, value, row_number() OVER (PARTITION BY term ORDER BY o) FROM (
  SELECT w AS term, w AS value, 0 AS o FROM vr UNION ALL SELECT w, unnest(vs), unnest(range(1, len(vs) + 1)) FROM vr) u
WHERE term IN (SELECT term FROM {v_alias_terms}) AND length(term) % 3 = 2
  AND NOT EXISTS (SELECT 1 FROM {v_blocked} b JOIN (SELECT term, min(form) AS k FROM tf GROUP BY term) bk ON bk.k = b.block_key
        WHERE bk.term = u.term AND b.alias = u.value AND u.value <> u.term)""",
        re=related_sql(),
    ),
)
def _expand(t: Tables) -> DataFrame:
    kind = F.length("term") % 3
    terms = t.v_alias_terms.withColumn("use_alias", kind == 0).withColumn("use_variant", kind != 1)
    return A.expand(terms, alias(t), variants(t), t.v_user_alias, t.v_blocked).select("term", "value", "ord")


USER_CHANGES = """
SELECT word, pos, CASE WHEN pos % 3 = 0 THEN NULL ELSE ' new' || CAST(pos AS STRING) || ' ' END AS alias FROM {v_user_alias} WHERE pos % 8 = 0"""


@query(
    "ali_07_user_lists",
    oracle(
        """SELECT word, CAST(pos AS BIGINT) AS pos, alias FROM {v_user_alias} WHERE word NOT IN (SELECT word FROM ch)
        UNION ALL SELECT word, CAST(pos AS BIGINT), trim(alias) FROM ch WHERE trim(alias) <> ''""",
        ch=USER_CHANGES,
    ),
)
def _user_lists(t: Tables) -> DataFrame:
    return A.upsert_lists(t.v_user_alias, t.sql(USER_CHANGES))


@query(
    "ali_07_blocked",
    alias_oracle(
        """SELECT bk.term, b.alias AS value FROM (SELECT term, min(form) AS k FROM tf GROUP BY term) bk JOIN (
        SELECT block_key, alias FROM {v_blocked} UNION SELECT word, alias FROM {v_user_alias}) b ON b.block_key = bk.k"""
    ),
)
def _blocked(t: Tables) -> DataFrame:
    session = t.v_user_alias.select(F.col("word").alias("block_key"), "alias")
    return A.blocked_terms(t.v_alias_terms, t.v_blocked, variants(t), session)


@query(
    "ali_08_enabled_sources",
    alias_oracle("SELECT source, CAST(count(*) AS BIGINT) AS n FROM al WHERE source <> 'place' GROUP BY source"),
)
def _enabled(t: Tables) -> DataFrame:
    switches = t.spark.createDataFrame([("place", False), ("org", True)], "source string, enabled boolean")
    return A.enabled_sources(alias(t), switches).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


MERGED = dict(
    mg="SELECT canon, alias, arg_min(source_rank, k) AS source_rank, min(k) AS k FROM (SELECT *, source_rank * 100000000 + line_no * 100 + pos AS k FROM al WHERE alias <> canon) GROUP BY canon, alias",
    ix="SELECT DISTINCT term, canon FROM (SELECT canon AS term, canon FROM mg UNION ALL SELECT alias, canon FROM mg)",
)


@query(
    "ali_10_lookup_all",
    alias_oracle(
        "SELECT t.term, ix.canon, mg.alias FROM {v_alias_terms} t JOIN ix USING (term) JOIN mg ON mg.canon = ix.canon WHERE mg.alias <> t.term",
        **MERGED,
    ),
)
def _lookup_all(t: Tables) -> DataFrame:
    return A.lookup_all(t.v_alias_terms, A.merge_layers(alias(t))).select("term", "canon", "alias")


@query(
    "ali_10_canonical_all",
    alias_oracle(
        "SELECT t.term, min(ix.canon) AS canon, CAST(count(*) AS BIGINT) AS people FROM {v_alias_terms} t JOIN ix USING (term) GROUP BY t.term",
        **MERGED,
    ),
)
def _canonical_all(t: Tables) -> DataFrame:
    return A.canonical_all(t.v_alias_terms, A.merge_layers(alias(t)))


@query(
    "ali_11_expand_all",
    alias_oracle(
        """
SELECT term, value FROM (SELECT term, value, row_number() OVER (PARTITION BY term ORDER BY canon, k) AS ord FROM (
  SELECT *, row_number() OVER (PARTITION BY term, value ORDER BY canon, k) AS rn FROM (
    SELECT t.term, ix.canon AS value, ix.canon, -1 AS k FROM {v_alias_terms} t JOIN ix USING (term)
    UNION ALL SELECT t.term, mg.alias, ix.canon, mg.k FROM {v_alias_terms} t JOIN ix USING (term) JOIN mg ON mg.canon = ix.canon) WHERE value <> term) WHERE rn = 1)""",
        **MERGED,
    ),
)
def _expand_all(t: Tables) -> DataFrame:
    return A.expand_all(t.v_alias_terms, A.merge_layers(alias(t)))


@query(
    "ali_11_expand_all_top",
    alias_oracle(
        """
SELECT term, value, CAST(ord AS BIGINT) AS ord FROM (SELECT term, value, row_number() OVER (PARTITION BY term ORDER BY canon, k) AS ord FROM (
  SELECT *, row_number() OVER (PARTITION BY term, value ORDER BY canon, k) AS rn FROM (
    SELECT t.term, ix.canon AS value, ix.canon, -1 AS k FROM {v_alias_terms} t JOIN ix USING (term)
    UNION ALL SELECT t.term, mg.alias, ix.canon, mg.k FROM {v_alias_terms} t JOIN ix USING (term) JOIN mg ON mg.canon = ix.canon) WHERE value <> term) WHERE rn = 1)
WHERE ord <= 16""",
        **MERGED,
    ),
)
def _expand_all_top(t: Tables) -> DataFrame:
    return A.expand_all(t.v_alias_terms, A.merge_layers(alias(t)), 16)


@query(
    "ali_12_merged_layers", alias_oracle("SELECT canon, alias, CAST(source_rank AS BIGINT) AS source_rank FROM mg", **MERGED)
)
def _merged_layers(t: Tables) -> DataFrame:
    return A.merge_layers(alias(t)).select("canon", "alias", F.col("source_rank").cast("long").alias("source_rank"))


@query(
    "ali_13_import_counts",
    alias_oracle(
        """SELECT CAST((SELECT count(DISTINCT canon) FROM al WHERE source <> 'main' AND canon NOT IN (SELECT canon FROM al WHERE source = 'main')) AS BIGINT) AS new_people,
        CAST((SELECT count(*) FROM (SELECT DISTINCT canon, alias FROM al WHERE source <> 'main' AND alias <> canon EXCEPT SELECT canon, alias FROM al WHERE source = 'main')) AS BIGINT) AS new_names"""
    ),
)
def _import_counts(t: Tables) -> DataFrame:
    a = alias(t)
    return A.import_counts(a.filter("source_rank = 0"), a.filter("source_rank > 0"))


@query(
    "ali_13_replaced_people",
    alias_oracle(
        """SELECT canon, alias FROM (SELECT canon, alias FROM al WHERE source = 'main' AND canon NOT IN (SELECT canon FROM al WHERE source = 'place')
        UNION ALL SELECT canon, alias FROM al WHERE source = 'place') WHERE canon NOT IN (SELECT canon FROM al WHERE source = 'org')"""
    ),
)
def _replaced(t: Tables) -> DataFrame:
    a = alias(t).select("source_rank", "canon", "alias")
    added = A.replace_people(a.filter("source_rank = 0"), a.filter("source_rank = 1"))
    return A.remove_people(added, a.filter("source_rank = 2")).select("canon", "alias")


@query(
    "ali_14_dictionary_counts",
    alias_oracle("SELECT CAST(count(DISTINCT canon) AS BIGINT) AS people, CAST(count(*) AS BIGINT) AS names FROM mg", **MERGED),
)
def _dictionary_counts(t: Tables) -> DataFrame:
    return A.dictionary_counts(A.merge_layers(alias(t)))


@query(
    "snk_02_dictionary_lines",
    alias_oracle("SELECT canon, canon || ',' || string_agg(alias, ',' ORDER BY k) AS line FROM mg GROUP BY canon", **MERGED),
)
def _dictionary_lines(t: Tables) -> DataFrame:
    return A.dictionary_lines(A.merge_layers(alias(t)))


AUDIT = dict(
    ex="SELECT * FROM al WHERE source <> 'main'",
    gr="SELECT DISTINCT source, source_rank, line_no, canon FROM ex",
    ow="SELECT term AS w, arg_min(canon, form) AS owner FROM (SELECT fm.term, fm.form, tc.canon FROM fm JOIN tc ON tc.term = fm.form AND tc.source = 'main') GROUP BY term",
    hv="SELECT DISTINCT l.canon AS owner, fm.form FROM lists l JOIN fm ON fm.term = l.alias WHERE l.source = 'main'",
    og="SELECT gr.*, ow.owner FROM gr JOIN ow ON ow.w = gr.canon",
    nw="""SELECT DISTINCT og.source, og.source_rank, og.line_no, og.canon, ex.alias FROM og JOIN ex USING (source, source_rank, line_no, canon)
WHERE NOT EXISTS (SELECT 1 FROM fm JOIN hv ON hv.form = fm.form WHERE fm.term = ex.alias AND hv.owner = og.owner)""",
)


@query(
    "ali_15_audit",
    alias_oracle(
        """
SELECT 'repeated_canon' AS rule, source, canon, '' AS detail FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY source_rank, line_no) AS rn FROM gr) WHERE rn > 1
UNION ALL SELECT 'one_char', source, canon, alias FROM ex WHERE length(alias) = 1
UNION ALL SELECT 'repeated_in_group', source, canon, alias FROM ex GROUP BY source, source_rank, line_no, canon, alias HAVING count(*) > 1 OR alias = canon
UNION ALL SELECT 'addition', source, canon, alias FROM nw
UNION ALL SELECT 'redundant', source, canon, owner FROM og WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.source = og.source AND nw.line_no = og.line_no AND nw.canon = og.canon)
UNION ALL SELECT 'other_owner', d.source, d.canon, d.alias FROM (SELECT DISTINCT source, line_no, canon, alias FROM ex) d JOIN ow oa ON oa.w = d.alias LEFT JOIN ow oc ON oc.w = d.canon
  WHERE oa.owner <> d.canon AND (oc.owner IS NULL OR oc.owner <> oa.owner)
UNION ALL SELECT 'spelling_only', ex.source, ex.canon, ex.alias FROM ex WHERE EXISTS (SELECT 1 FROM fm WHERE fm.term = ex.canon AND fm.form = ex.alias)""",
        **AUDIT,
    ),
)
def _audit(t: Tables) -> DataFrame:
    a = alias(t)
    return A.audit(a.filter("source_rank > 0"), a.filter("source_rank = 0"), variants(t))


WORDS = """
SELECT 'w' AS source, 0 AS source_rank, doc_id AS line_no,
  regexp_extract(text, '([A-Za-z]{4,8})', 1) || ',' || regexp_extract(text, '([a-z]{3})', 1) || ',' || substr(source, 1, 3) AS line FROM {documents}"""


@query(
    "ali_16_entity_counts",
    oracle(
        """
SELECT canon, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS mentions FROM (
  SELECT k.canon, p.doc_id, sum(CAST((length(p.t) - length(replace(p.t, k.term, ''))) / length(k.term) AS BIGINT)) AS n
  FROM tc k JOIN p ON contains(p.t, k.term) GROUP BY 1, 2) GROUP BY canon""",
        v_alias_lines=WORDS,
        parsed=CTES["parsed"].replace("{v_alias_lines}", "v_alias_lines"),
        al=CTES["al"],
        heads=CTES["heads"],
        tc=CTES["tc"],
        p=PAGES_SQL,
    ),
)
def _entity_counts(t: Tables) -> DataFrame:
    lookup = cut_lineage(A.to_canon(A.parse_alias_lines(t.sql(WORDS))), "lookup")
    names = lookup.select("term").withColumn("pos", F.lit(0))
    return A.entity_counts(S.page_hits(doc_pages(t), names), lookup)


SHADOW_TERMS = """
SELECT CAST(c_custkey % 200 AS BIGINT) AS query_id, CAST(c_custkey AS BIGINT) AS pos,
  CASE c_custkey % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'namé' WHEN 2 THEN 'tówn' ELSE 'nick' END || CAST(c_custkey % 7 AS STRING) AS term FROM {customer}"""
SHADOW_SEEDS = "SELECT DISTINCT CAST(c_custkey % 200 AS BIGINT) AS query_id, 'name' || CAST(c_custkey % 200 % 7 AS STRING) AS seed FROM {customer}"


@query(
    "ali_17_shadow_spellings",
    oracle(
        """
SELECT f.query_id, f.value, f.source_term, CAST(f.pos AS BIGINT) AS pos FROM f LEFT JOIN (SELECT query_id, source_term, min(pos) AS used FROM f GROUP BY 1, 2) u
ON u.query_id = f.query_id AND u.source_term = f.value WHERE u.used IS NULL OR u.used > f.pos""",
        st=SHADOW_TERMS,
        se=SHADOW_SEEDS,
        src="SELECT query_id, pos, term FROM st UNION ALL SELECT query_id, -1, seed FROM se",
        vr=variants_sql("SELECT DISTINCT term AS w FROM src"),
        pairs="SELECT src.query_id, src.pos, src.term AS source_term, unnest(range(len(vs))) AS v_pos, unnest(vs) AS value FROM src JOIN vr ON vr.w = src.term",
        bad="SELECT se.query_id, b.alias AS value FROM se JOIN (SELECT w, list_min(list_append(vs, w)) AS k FROM vr) v ON v.w = se.seed JOIN {v_blocked} b ON b.block_key = v.k",
        f="""SELECT query_id, value, arg_min(source_term, (pos + 1) * 100 + v_pos) AS source_term, arg_min(pos, (pos + 1) * 100 + v_pos) AS pos
FROM pairs JOIN se USING (query_id) WHERE value <> seed AND (query_id, value) NOT IN (SELECT (query_id, value) FROM bad) GROUP BY query_id, value""",
    ),
)
def _shadows(t: Tables) -> DataFrame:
    return A.shadow_variants(t.sql(SHADOW_TERMS), t.sql(SHADOW_SEEDS), variants(t), t.v_blocked)


# Biographical tables from orders and customers; names are Chinese numerals of the keys.
PEOPLE = """
SELECT c_custkey AS person_id, '客' || translate(CAST(c_custkey % 800 AS STRING), '0123456789', '〇一二三四五六七八九') AS name,
  CAST(1600 + c_custkey % 300 AS INT) AS year FROM {customer}"""
ALT_NAMES = """
SELECT o_custkey AS person_id, o_orderkey AS seq,
  CASE o_orderkey % 4 WHEN 0 THEN 'Mr ' ELSE '號' END || translate(CAST(o_orderkey % 5000 AS STRING), '0123456789', '零壹贰叁肆伍陆柒捌玖')
  || CASE WHEN o_orderkey % 9 = 0 THEN ' latin letters' ELSE '' END AS alt_name FROM {orders}"""


@query(
    "join_06_people_from_biographies",
    oracle(
        """
SELECT DISTINCT canon, alias FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY seq, alias) AS rn FROM (
  SELECT p.person_id, p.name AS canon, a.alt_name AS alias, min(a.seq) AS seq FROM pe p JOIN an a USING (person_id)
  WHERE p.year BETWEEN 1650 AND 1850 AND a.alt_name <> p.name
    AND len(regexp_extract_all(a.alt_name, '[\\x{4E00}-\\x{9FFF}]')) >= 2
    AND len(regexp_extract_all(a.alt_name, '[\\x{4E00}-\\x{9FFF}]')) >= length(a.alt_name) * 0.6
  GROUP BY 1, 2, 3)) """,
        pe=PEOPLE,
        an=ALT_NAMES,
    ),
)
def _people(t: Tables) -> DataFrame:
    return A.people_from_biographies(t.sql(PEOPLE), t.sql(ALT_NAMES), year_from=1650, year_to=1850)


@query(
    "join_06_people_top",
    oracle(
        """
SELECT DISTINCT canon, alias FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY seq, alias) AS rn FROM (
  SELECT p.person_id, p.name AS canon, a.alt_name AS alias, min(a.seq) AS seq FROM pe p JOIN an a USING (person_id)
  WHERE p.year BETWEEN 1650 AND 1850 AND a.alt_name <> p.name
    AND len(regexp_extract_all(a.alt_name, '[\\x{4E00}-\\x{9FFF}]')) >= 2
    AND len(regexp_extract_all(a.alt_name, '[\\x{4E00}-\\x{9FFF}]')) >= length(a.alt_name) * 0.6
  GROUP BY 1, 2, 3)) WHERE rn <= 8""",
        pe=PEOPLE,
        an=ALT_NAMES,
    ),
)
def _people_top(t: Tables) -> DataFrame:
    return A.people_from_biographies(t.sql(PEOPLE), t.sql(ALT_NAMES), max_aliases=8, year_from=1650, year_to=1850)
