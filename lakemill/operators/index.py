"""Index lookups: filters that Parquet statistics can use, within what an index's method offers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.catalog import Index
from lakemill.dialect import to_spark
from lakemill.errors import EngineError

#: Fixed value: what an entry counts for in an index's size.
ENTRY_BYTES = 64


def new_counts() -> dict[str, int]:
    return {"lookups": 0, "inserts": 0, "deletes": 0}


class IndexHandle:
    """Reads a table by an index's columns. Keys are values, or tuples for several columns (or their first ones).
    A partial index has the rows that its condition holds for. ``counts`` is shared by all handles of an engine."""

    def __init__(self, index: Index, rows: DataFrame, counts: dict[str, int] | None = None):
        self.index, self.rows = index, rows.where(to_spark(index.where)) if index.where else rows
        self.counts = counts if counts is not None else new_counts()

    def _pairs(self, key: Any) -> list[tuple[str, Any]]:
        key = key if isinstance(key, (tuple, list)) else (key,)
        return list(zip(self.index.columns, key, strict=False))

    def get(self, key: Any) -> DataFrame:
        self.counts["lookups"] += 1
        out = self.rows
        for c, v in self._pairs(key):
            out = out.where(F.col(f"`{c}`") == F.lit(v))
        return out

    def range(self, start: Any, end: Any) -> DataFrame:
        """Keys from ``start`` to ``end``, both included, in order; None is no bound. Not on HASH indexes."""
        if self.index.method == "HASH":
            raise EngineError(f"index {self.index.name} is a HASH index and has no ranges")
        self.counts["lookups"] += 1
        column, out = F.col(f"`{self.index.columns[0]}`"), self.rows
        if start is not None:
            out = out.where(column >= F.lit(start))
        if end is not None:
            out = out.where(column <= F.lit(end))
        return out.orderBy(*self.index.columns)

    def scan(self) -> DataFrame:
        return self.rows if self.index.method == "HASH" else self.rows.orderBy(*self.index.columns)

    def stats(self) -> dict[str, int]:
        """Entries (rows with a key), their size at ``ENTRY_BYTES`` each, and what the engine has counted."""
        entries = self.rows.dropna(subset=self.index.columns).count()
        return {"entries": entries, "size": ENTRY_BYTES * entries, **self.counts}


def key_range(rows: DataFrame, column: str, start: Any = None, end: Any = None, include_start: bool = True, include_end: bool = False, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Rows by ``column`` from ``start`` to before ``end`` in order, the bounds' inclusion as told."""
    c = F.col(column)
    if start is not None:
        rows = rows.where(c >= F.lit(start) if include_start else c > F.lit(start))
    if end is not None:
        rows = rows.where(c <= F.lit(end) if include_end else c < F.lit(end))
    rows = rows.orderBy(c.desc() if reverse else c.asc())
    return rows.limit(limit) if limit is not None else rows
