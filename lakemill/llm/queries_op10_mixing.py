"""op10: the documents drawn, with repetition, to bring the sources to tempered weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import documents
from lakemill.llm.mixing import Mix, draw, n_tokens


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each drawn copy: doc_id, source, n_tokens, pass, block and position (0 to 1) in the output."""
    drawn, _ = draw(documents(spark, sf_dir, "doc_id", "source", "text"), Mix(entropy=0.97, most_repeats=4.0))
    return drawn.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), F.col("_pass").alias("pass"), F.col("_block").alias("block"), F.col("_position").alias("position"))
