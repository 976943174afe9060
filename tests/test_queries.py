"""Every query with a SQL twin gives the twin's rows."""

import difflib

import duckdb
import pytest

from concord.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    return "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(cell(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() >= 0
    spark.catalog.clearCache()


def test_fuzzy_grounding_equals_brute_force(spark, sf_dir):
    """Ratio to the text around the longest common block, whole texts read one at a time."""
    got = {int(r["id"]): r for r in registry.QUERIES["ground_fuzzy"](spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(got) == set(docs)
    fuzzy = 0
    for i, text in docs.items():
        quote = " ".join(f"{text[4:44]}qq {text[44:84]}".split()).lower()
        page = " ".join(text.split()).lower()
        if len(quote) < 12 or quote in page:
            continue
        block = difflib.SequenceMatcher(None, quote, page, autojunk=False).find_longest_match()
        near = page[max(0, block.b - block.a - 10) :][: len(quote) + 20]
        ratio = round(difflib.SequenceMatcher(None, quote, near, autojunk=False).ratio(), 3) if block.size >= 12 else 0
        if ratio >= 0.62:
            fuzzy += 1
            assert (got[i]["mode"], got[i]["ratio"], got[i]["verified"]) == ("fuzzy", ratio, ratio >= 0.8)
        else:
            assert got[i]["mode"] != "fuzzy"
    assert fuzzy > 100


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
