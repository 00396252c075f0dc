"""The registered queries: against their SQL where there is one, and whole tables in any case."""

import importlib

import pytest

from tests.conftest import DATA

duckdb = pytest.importorskip("duckdb")
entry = importlib.import_module("__spark_entry__")
llm = importlib.import_module("caseflow.llm.queries")


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    canonical = lambda df: sorted(map(tuple, df[columns].astype(str).itertuples(index=False)))
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.ORACLE)))
def test_query_answers_every_row(spark, name):
    key = "page_id" if name == "op9_urls" else "doc_id"
    source = spark.read.parquet(f"{DATA}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    found = entry.queries()[name](spark, DATA)
    assert found.select(key).distinct().count() == source.select(key).distinct().count()
