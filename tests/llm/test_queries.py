"""The registered queries that SQL can express, against DuckDB; and the pipeline."""

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_quality_rules", "op7_mixed_sources"])
def test_query_equals_sql(spark, name):
    from palaver.llm.queries import QUERIES, SQL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, FOLDER).collect())
    assert got == sorted(want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, FOLDER).cache()
        if name != "pieces":
            assert docs.columns == columns
        if name != "mixing":
            assert docs.count() <= before
    assert 0 < docs.count() and docs.where("n_tokens <> size(ids)").isEmpty()


def test_stages_take_odd_documents(spark):
    import corpus_pipeline
    from tests.llm.test_text_operators import DOCS, ODD
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, DOCS)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns
            if name == "near_duplicates":
                assert out.where("doc_id in (1, 4)").count() == (1 if rows else 0)
            out.collect()
