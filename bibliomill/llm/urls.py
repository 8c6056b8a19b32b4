"""URL filters by hash prefixes.

Every URL is expanded into the host suffixes and path prefixes that a rule could name.  The
expressions are joined with the rules on the first digits of their SHA-256, an equi-join
whose keys are small and even; then the whole digests are compared and the longest rule wins.
Only suffixes of as many labels, and prefixes of as many characters, as some rule has are
made; these two short lists are the only thing read from the rules before the join.

Only DataFrame functions are used.

Defined cases: a null URL, or one without "://", has an empty host and path and fits no rule;
a path must begin with the rule's path, so a URL without path fits no rule that asks for "/";
of two rules of equal length, block wins; a rule named twice counts once; repeated rows keep
their number; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliomill.llm.common import broadcast_up_to

# The rules of the contract, in its order.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
PREFIX_DIGITS = 8
DEFAULT = "allow"
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contract_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{action}', '{rule}')" for action, rule in RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(action, rule)")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_parts(rules: DataFrame) -> DataFrame:
    """Host and path of a rule: the host ends before the first slash."""
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    return rules.where("rule IS NOT NULL AND action IS NOT NULL").select("action", "rule", host.alias("rule_host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"))


def expressions(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(k) for k in label_counts]), lambda k: k <= n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(k) for k in path_lengths]), lambda k: k <= F.length(path)), lambda k: F.substring(path, F.lit(1), k)
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    parts = _rule_parts(rules)
    # as long as the distinct label counts and path lengths of the rules, not as the rules
    label_counts = sorted(r[0] for r in parts.select(F.size(F.split("rule_host", r"\.", -1))).distinct().collect())
    path_lengths = sorted(r[0] for r in parts.select(F.length("rule_path")).distinct().collect())
    digest = F.sha2(F.concat("rule_host", "rule_path"), 256)
    known = broadcast_up_to(parts.select("action", "rule", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("short")), BROADCAST_RULES)
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if label_counts:
        made = expressions(F.col("host"), F.col("path"), label_counts, path_lengths)
    else:
        made = F.array().cast("array<string>")
    # the first, empty expression stands for the page itself
    expanded = split.withColumn("digest", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.transform(made, lambda e: F.sha2(e, 256)))))
    met = expanded.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)).join(known, "short", "left")
    fits = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule").alias("size"), (F.col("action") == "block").alias("blocks"), "rule", "action"))
    best = met.groupBy("page_id", "host", "path").agg(
        F.max(fits).alias("best"), F.count(F.when(F.col("digest").isNull(), 1)).alias("copies")
    )
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )


def url_report(pages: DataFrame) -> DataFrame:
    return judge(pages, contract_rules(pages.sparkSession))


URLS_SQL = """
WITH r(action, rule, h, p) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
u AS (SELECT page_id, row_number() OVER () AS n,
        CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT s.n, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
      FROM s JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p) GROUP BY s.n)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM s LEFT JOIN m USING (n)
"""
