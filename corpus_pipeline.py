"""A corpus pipeline of five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents. A stage's scratch tables go when the next begins.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import common
from lakemill.llm.common import held_out
from lakemill.llm.language_id import predict, train
from lakemill.llm.mixing import Mix, mixed
from lakemill.llm.near_dedup import without_duplicates
from lakemill.llm.packing import pack_documents
from lakemill.llm.suffix_dedup import remove_repeats


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID accepts: not those without letters, nor those like no language that it knows."""
    with common.scratch(spark, "pipeline"):
        model = train(docs.where(~held_out(F.col("doc_id"))))
        return predict(docs, model, reject=True).where(F.col("lang_pred") != "und").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each class of near duplicates: five-word shingles, similarity 0.8."""
    with common.scratch(spark, "pipeline"):
        return without_duplicates(docs, shingle=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that also start earlier; documents of which nothing is left go."""
    with common.scratch(spark, "pipeline"):
        left = remove_repeats(docs, length=100, keep_columns=True)
    changed = F.col("n_removed") > 0
    rows = left.where(~changed | F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]"))
    columns = [F.col("kept_text").alias("text") if c == "text" else F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(columns)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at op10's target, an entropy of 0.97, or as even as they get when none is cut and none is repeated more
    than four times, in blocks at these weights."""
    with common.scratch(spark, "pipeline"):
        return mixed(docs, Mix(entropy=0.97, most_repeats=4.0, budget=None))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids; a row for each piece of a document, as pack_documents() gives them."""
    with common.scratch(spark, "pipeline"):
        # Workers live through all stages, so what packing keeps is memory that the others don't have.
        return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=300_000)


STAGES = [
    ("language_id", languages),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mixing", source_weights),
    ("packing", sequences),
]

#: Tokenizers and trained models can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = common.scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
