"""op3: the toxicity of every document, learned from the labelled rows that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import documents, held_out, read
from lakemill.llm.toxicity import score, train


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id"))))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
