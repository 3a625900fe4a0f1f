"""op8: fingerprints of every document and of its edited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakemill.llm.common import documents
from lakemill.llm.fingerprints import with_next


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir))
