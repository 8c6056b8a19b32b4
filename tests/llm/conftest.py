"""Views of the given tables that a test's own SQL reads and the test does not make."""

import pytest

from bibliomill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def further_tables(request, monkeypatch):
    name = getattr(getattr(request.node, "callspec", None), "params", {}).get("name")
    if name not in queries.ORACLES:
        return
    duckdb = pytest.importorskip("duckdb")
    plain = duckdb.connect

    def connect(*args, **more):
        con = plain(*args, **more)
        for table in ("embeddings", "conversations"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        return con

    monkeypatch.setattr(duckdb, "connect", connect)
