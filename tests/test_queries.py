"""The registered queries themselves, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from bibliomill.plans.registry import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
SOME = ["txt_13_terms_by_targets", "cat_01_snapshot_diff", "ali_10_lookup_all", "bib_22_redundant_texts", "dat_12_day_codes", "join_05_relocated_few_rules", "src_08_excerpts", "str_02_progressive_search", "join_05_relocated_edge_rules", "cat_10_book_files", "bib_08_colophon_page", "txt_12_query_groups"]


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "words", "most_pages", "count"] and 0 < len(df.collect()) <= 20


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_check(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert got == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=repr)
