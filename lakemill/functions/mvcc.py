"""Multi-version reads over a table of versions: a key, a time, whether it is committed and whether it deletes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_at(versions: DataFrame, key: list[str], time: str, at: Any, committed: str | None = None, deleted: str | None = None, tie: list[str] = ()) -> DataFrame:
    """The latest committed version of each key at or before ``at``, keys whose latest version deletes left out.

    One aggregation by key that combines before it shuffles: the newest row is the maximum of a struct.
    ``tie``: columns that order versions of one time.
    """
    rows = versions.where(F.col(time) <= F.lit(at))
    if committed:
        rows = rows.where(F.col(committed))
    rest = [c for c in versions.columns if c not in {*key, time, *tie}]
    newest = rows.groupBy(*key).agg(F.max(F.struct(time, *tie, *rest)).alias("_v"))
    out = newest.select(*(F.col(c) if c in key else F.col(f"_v.{c}").alias(c) for c in versions.columns))
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def collect_garbage(versions: DataFrame, key: list[str], time: str, committed: str, active: int) -> DataFrame:
    """With no active transaction the latest committed version of each key; with any, all versions."""
    if active:
        return versions
    w = Window.partitionBy(*key).orderBy(F.desc(time))
    return versions.where(F.col(committed)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def version_stats(versions: DataFrame, key: list[str], transaction: str, committed: str) -> DataFrame:
    """One row: keys, versions, active_transactions (those with a version that isn't committed)."""
    return versions.agg(
        F.count_distinct(*key).alias("keys"),
        F.count("*").alias("versions"),
        F.count_distinct(F.when(~F.col(committed), F.col(transaction))).alias("active_transactions"),
    )


def conflicts(accesses: DataFrame, transaction: Any) -> DataFrame:
    """Conflicts of a committing transaction with the others in ``accesses`` (txn, key, kind "read" or "write", ts).

    WriteWrite: both write a key. ReadWrite: it writes what the other read before. WriteRead: it read what the
    other wrote after. Returns conflict_type, key, txn, other_txn, ts, other_ts. A row for each key, kind and
    transaction is expected, the last access counting.
    """
    last = accesses.groupBy("txn", "key", "kind").agg(F.max("ts").alias("ts"))
    own = last.where(F.col("txn") == F.lit(transaction))
    other = last.where(F.col("txn") != F.lit(transaction)).select(F.col("txn").alias("other_txn"), "key", F.col("kind").alias("other_kind"), F.col("ts").alias("other_ts"))
    kind = (
        F.when((F.col("kind") == "write") & (F.col("other_kind") == "write"), "WriteWrite")
        .when((F.col("kind") == "write") & (F.col("other_kind") == "read") & (F.col("other_ts") < F.col("ts")), "ReadWrite")
        .when((F.col("kind") == "read") & (F.col("other_kind") == "write") & (F.col("other_ts") > F.col("ts")), "WriteRead")
    )
    return own.join(other, "key").withColumn("conflict_type", kind).where("conflict_type IS NOT NULL").select("conflict_type", "key", "txn", "other_txn", "ts", "other_ts")


def would_conflict(accesses: DataFrame, transaction: Any, key: Any, writes: bool) -> bool:
    """Whether reading or writing a key now would conflict with another transaction's access."""
    others = accesses.where((F.col("txn") != F.lit(transaction)) & (F.col("key") == F.lit(key)))
    return not (others if writes else others.where("kind = 'write'")).isEmpty()
