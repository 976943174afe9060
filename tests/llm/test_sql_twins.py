"""Corpus queries whose results SQL can state give the twin's rows, on the small table and on odd rows."""

import duckdb
import pytest

from concord.llm import queries, substring_dedup


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_substring_sql_on_odd_rows(odd_docs, tmp_path):
    """Ids are unique in the documents table, so the twin is held to rows with unique ids."""
    docs = odd_docs.where("doc_id IS NOT NULL AND doc_id NOT IN (12, 13)").select("doc_id", "text")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLES["op10_substring_dedup"]).fetchall())
    got = substring_dedup.dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == want
