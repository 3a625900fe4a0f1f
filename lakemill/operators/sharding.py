"""Which shard a row belongs to."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_shard(key: Column, shards: int) -> Column:
    """Number of the shard, by the key itself where it is an integer, else by its hash: equal keys share a shard.
    A null key is in shard 0."""
    whole = F.typeof(key).isin("tinyint", "smallint", "int", "bigint")
    # The type is known when the query is planned, and the branch that isn't taken goes.
    number = F.when(whole, F.coalesce(key.cast("string").try_cast("long"), F.lit(0))).otherwise(F.when(key.isNull(), F.lit(0)).otherwise(F.xxhash64(key)))
    return F.pmod(number, F.lit(shards)).cast("int")


def range_shard(key: Column, bounds: list[Any]) -> Column:
    """Number of ascending ``bounds`` (values or expressions) at or below the key: shard i holds bounds[i-1] <= key <
    bounds[i]. A null key is in the last one."""
    out = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(key < (b if isinstance(b, Column) else F.lit(b)), F.lit(i)).otherwise(out)
    return out.cast("int")


def by_shard(rows: DataFrame, shard: Column, shards: int) -> DataFrame:
    """Rows of a shard in one partition each."""
    return rows.withColumn("shard", shard).repartition(shards, "shard")
