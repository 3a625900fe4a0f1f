"""op1: every document tokenized, cut and packed into sequences of 2048 ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakemill.llm.common import documents
from lakemill.llm.packing import pack_documents


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
