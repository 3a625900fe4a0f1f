import corpus_pipeline
import duckdb
import pytest
from test_catalogue import plain

from lakemill.llm import common, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = common.documents(spark, SF)
    columns = docs.columns
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0 or name == "language_id"
    start, lang, near, suffix, mixed, packed = counts
    assert start >= lang >= near >= suffix and mixed >= suffix and packed >= mixed
    assert lang == start  # all are prose


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, documents, empty, stage, tmp_path):
    rows = stage(spark, documents, SF)
    rows.write.parquet(f"{tmp_path}/a")
    assert stage(spark, empty, SF).count() == 0
    extra = documents.withColumnsRenamed({}).selectExpr("*", "1 AS key", "2 AS _text", "3 AS kept_text", "4 AS fp")
    assert stage(spark, extra, SF).count() == spark.read.parquet(f"{tmp_path}/a").count()


def test_languages_rejects_only_what_has_no_letters(spark, documents):
    kept = corpus_pipeline.languages(spark, documents, SF)
    gone = {r.doc_id for r in documents.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {24, 25, 26, 27}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
