"""Every query of the engine against its SQL on the smallest tables; pure-Python oracles where there is no SQL."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import catalogue
from lodestone.sources import corpus

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == want


def test_all_queries_are_registered(spark):
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_ranked_search_against_plain_python(spark):
    docs = {r["id"]: r for r in corpus.corpus_documents(spark, SF).collect()}
    texts = {r["doc_id"] + 1: r["text"] for r in corpus.table(spark, SF, "documents").collect()}
    want = []
    for ident, d in docs.items():
        if "the" in d["filename"].lower():
            want.append((-3, -d["modified_at_ms"], d["path"].encode("utf-16-be"), ident))
        elif "the" in texts[ident].lower():
            want.append((-1, -d["modified_at_ms"], d["path"].encode("utf-16-be"), ident))
    assert [r["id"] for r in catalogue.QUERIES["search_phrase_top20"](spark, SF).collect()] == [w[3] for w in sorted(want)][:20]


@pytest.mark.parametrize("name", ["snippet_page", "parse_html_blocks", "context_bundle"])
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
