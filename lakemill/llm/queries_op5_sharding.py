"""op5: the documents appended in four arrivals, compacted after each, and read back from the last manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import documents, scratch_path
from lakemill.llm.sharding import ShardStore

ARRIVALS = 4
ORACLE = "SELECT doc_id, COALESCE(octet_length(encode(text)), 0)::BIGINT AS n_bytes, sha256(COALESCE(text, '')) AS text_sha256, TRUE AS shard_ok FROM documents"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document as read back from the shards of the last manifest: doc_id, n_bytes, text_sha256 (null
    text: empty), and whether the shard that holds it is no larger than two target sizes and has the rows it is listed with."""
    docs = documents(spark, sf_dir)
    store = ShardStore(spark, scratch_path(spark, "shards"))
    # Arrivals are ranges of doc_id, so that each reads only its own row groups.
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / ARRIVALS for k in range(1, ARRIVALS)], 0.01)))
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        arrival = docs
        if low is not None:
            arrival = arrival.where(F.col("doc_id") >= low)
        if high is not None:
            arrival = arrival.where((F.col("doc_id") < high) | F.col("doc_id").isNull() if low is None else F.col("doc_id") < high)
        store.append(arrival)
        store.compact(docs.schema)
        store.expire(keep=1)
    shards = spark.createDataFrame([(s.path.rpartition("/")[2], s.rows, s.bytes <= 2 * store.target) for s in store.shards()], "shard string, listed long, fits boolean")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = store.read(docs.schema).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), F.col("_metadata.file_name").alias("shard"))
    right = held.groupBy("shard").count().join(shards, "shard").select("shard", (F.col("fits") & (F.col("count") == F.col("listed"))).alias("shard_ok"))
    return held.join(right, "shard").drop("shard")
