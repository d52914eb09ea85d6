"""Registered queries with SQL against DuckDB on the smallest tables; the others return all rows."""

import os

import pytest

from ionframe.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(frame, cols):
    return sorted(map(tuple, frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for n in ("documents", "embeddings"):
        c.sql(f"create view {n} as select * from '{SF}/{n}.parquet'")
    got, want = q.QUERIES[name](spark, SF).toPandas(), c.sql(q.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name, table", [("op2_html_text", "pages"), ("op4_quality", "documents"), ("op5_language", "documents"), ("op6_pii", "documents"), ("op7_secrets", "documents")])
def test_one_row_per_input_row(spark, name, table):
    assert q.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n
    assert p.run(spark, SF).count() == packed.count()
