"""Registered queries of this subpackage: one for each operator and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bibliomill.llm import html, jaccard, language, licenses, minhash, mixing, negatives, packing, quality, secrets, simhash, trie, urls
from bibliomill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": lambda spark, d: language.language_report(table(spark, d, "documents")),
    "op2_minhash": lambda spark, d: minhash.fingerprint_report(table(spark, d, "documents")),
    "op3_main_text": lambda spark, d: html.extraction_report(table(spark, d, "pages")),
    "op4_secret_scan": lambda spark, d: secrets.secret_report(table(spark, d, "documents")),
    "op5_quality_rules": lambda spark, d: quality.quality_report(table(spark, d, "documents")),
    "op6_url_filter": lambda spark, d: urls.url_report(table(spark, d, "pages")),
    "op7_simhash": lambda spark, d: simhash.simhash_report(table(spark, d, "documents")),
    "op8_license_scan": lambda spark, d: licenses.license_report(table(spark, d, "documents")),
    "op9_best_fit_packing": lambda spark, d: packing.packed_pieces(table(spark, d, "documents")),
    "op10_source_mix": lambda spark, d: mixing.mix_report(table(spark, d, "documents")),
    "op11_jaccard_join": lambda spark, d: jaccard.join_report(table(spark, d, "documents")),
    "op12_hard_negatives": lambda spark, d: negatives.hard_negatives(table(spark, d, "embeddings")),
    "op13_prefix_trie": lambda spark, d: trie.trie_report(table(spark, d, "conversations")),
}
ORACLES: dict[str, str] = {
    "op4_secret_scan": secrets.SECRETS_SQL,
    "op6_url_filter": urls.URLS_SQL,
    "op11_jaccard_join": jaccard.JOIN_SQL,
    "op12_hard_negatives": negatives.NEGATIVES_SQL,
    "op13_prefix_trie": trie.TRIE_SQL,
}
