"""Tables fed by streams, and results read as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakemill.session import Engine


def append_stream(engine: Engine, stream: DataFrame, table: str, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Commit each micro-batch of the stream called ``name`` to a table as one version. A batch that is run again after
    a failure is committed once: its number is part of the commit."""

    def commit(batch: DataFrame, number: int) -> None:
        engine.append(table, batch, (name, number))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, lateness: str) -> DataFrame:
    """Counts by key and tumbling window; rows later than ``lateness`` are left out."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
