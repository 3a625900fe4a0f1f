"""Table and column statistics, selectivities and costs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Fixed values of the cost model: costs of a sequential and a random page read, of a CPU step and of a network
# transfer; bytes of a page; selectivities where nothing is known; rows of an unknown table.
SEQUENTIAL_IO = 1.0
RANDOM_IO = 4.0
CPU = 0.01
NETWORK = 10.0
PAGE = 8192
UNKNOWN_EQUAL = 0.1
UNKNOWN_NOT_EQUAL = 0.9
RANGE = 0.33
UNKNOWN = 0.5
UNKNOWN_ROWS = 1000


@dataclass
class ColumnStats:
    distinct_count: int = 0
    null_count: int = 0
    min_value: Any = None
    max_value: Any = None
    histogram: list[tuple[float, float, int]] = field(default_factory=list)


@dataclass
class TableStats:
    row_count: int = 0
    total_size: int = 0
    columns: dict[str, ColumnStats] = field(default_factory=dict)

    @property
    def avg_row_size(self) -> int:
        return self.total_size // self.row_count if self.row_count else 0


@dataclass
class Cost:
    cpu: float
    io: float
    network: float
    total: float


def column_stats(df: DataFrame, *columns: str, exact: bool = True, more: tuple[SparkColumn, ...] = ()) -> DataFrame:
    """One row: row_count, for each column NAME_distinct, NAME_nulls, NAME_min, NAME_max, and ``more`` aggregates.

    Distinct counts are exact, for which Spark shuffles a row for each column and distinct value; without ``exact``
    they are HyperLogLog estimates (a relative error of about 2 %), in one pass without that shuffle.
    """
    aggregates = [F.count("*").alias("row_count"), *more]
    for c in columns:
        col = F.col(f"`{c}`")
        aggregates += [
            (F.count_distinct(col) if exact else F.approx_count_distinct(col, 0.02)).alias(f"{c}_distinct"),
            (F.count("*") - F.count(col)).alias(f"{c}_nulls"),
            F.min(col).alias(f"{c}_min"),
            F.max(col).alias(f"{c}_max"),
        ]
    return df.agg(*aggregates)


def histogram(df: DataFrame, column: str, width: float, buckets: int, low: float = 0.0) -> DataFrame:
    """(bucket, row_count) by equal widths from ``low``; values beyond fall in the first or last bucket, nulls in none."""
    b = F.least(F.floor((F.col(column) - low) / width).cast("int"), F.lit(buckets - 1))
    return df.where(F.col(column).isNotNull()).groupBy(F.greatest(b, F.lit(0)).alias("bucket")).agg(F.count("*").alias("row_count"))


class Statistics:
    """What is known of tables, by name."""

    def __init__(self):
        self.tables: dict[str, TableStats] = {}

    @classmethod
    def collect(cls, tables: dict[str, DataFrame], buckets: int = 10, exact: bool = True) -> Statistics:
        """One aggregation a table, and one more for the histograms of its numeric columns. ``exact``: see column_stats()."""
        out = cls()
        for name, df in tables.items():
            plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
            size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in plain), F.lit(0))
            row = column_stats(df, *plain, exact=exact, more=(F.coalesce(F.sum(size), F.lit(0)).alias("_size"),)).first()
            t = TableStats(row["row_count"], row["_size"])
            for c in plain:
                t.columns[c] = ColumnStats(row[f"{c}_distinct"], row[f"{c}_nulls"], row[f"{c}_min"], row[f"{c}_max"])
            numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and t.columns[f.name].min_value is not None]
            if numeric:
                width = {c: (float(t.columns[c].max_value) - float(t.columns[c].min_value)) / buckets or 1.0 for c in numeric}
                place = {c: F.least(F.floor((F.col(f"`{c}`").cast("double") - float(t.columns[c].min_value)) / width[c]), F.lit(buckets - 1)) for c in numeric}
                counts = df.agg(*(F.count_if(place[c] == i).alias(f"{c}_{i}") for c in numeric for i in range(buckets))).first()
                for c in numeric:
                    low = float(t.columns[c].min_value)
                    t.columns[c].histogram = [(low + i * width[c], low + (i + 1) * width[c], counts[f"{c}_{i}"]) for i in range(buckets)]
            out.tables[name] = t
        return out

    def update(self, name: str, stats: TableStats) -> None:
        self.tables[name] = stats

    def as_df(self, spark: SparkSession) -> DataFrame:
        rows = [(n, t.row_count, t.total_size, c, s.distinct_count, s.null_count, None if s.min_value is None else str(s.min_value), None if s.max_value is None else str(s.max_value)) for n, t in self.tables.items() for c, s in t.columns.items()]
        return spark.createDataFrame(rows, "table_name string, row_count long, total_size long, column_name string, distinct_count long, null_count long, min_value string, max_value string")

    def selectivity(self, table: str, column: str, operator: str) -> float:
        """Share of rows for which ``column operator value`` is expected to hold."""
        stats = self.tables.get(table)
        if stats is None or column not in stats.columns:
            return UNKNOWN
        n = stats.columns[column].distinct_count
        if operator == "=":
            return 1 / n if n else UNKNOWN_EQUAL
        if operator in ("!=", "<>"):
            return 1 - 1 / n if n else UNKNOWN_NOT_EQUAL
        return RANGE if operator in ("<", "<=", ">", ">=") else UNKNOWN

    @staticmethod
    def both(a: float, b: float) -> float:
        return a * b

    @staticmethod
    def either(a: float, b: float) -> float:
        return a + b - a * b

    def rows(self, table: str, selectivity: float = 1.0) -> int:
        return int(self.tables[table].row_count * selectivity) if table in self.tables else UNKNOWN_ROWS

    # Costs

    @staticmethod
    def seq_scan(rows: int, row_size: int) -> float:
        return rows * row_size // PAGE * SEQUENTIAL_IO + rows * CPU

    @staticmethod
    def index_scan(selectivity: float, rows: int) -> float:
        return int(rows * selectivity) * RANDOM_IO + rows * CPU

    @staticmethod
    def hash_join(build: int, probe: int) -> float:
        return (2 * build + probe) * CPU

    @staticmethod
    def nested_loop(outer: int, inner: int) -> float:
        return float(outer) * inner * CPU

    @staticmethod
    def sort(rows: int) -> float:
        return rows * math.log2(rows) * CPU if rows else 0.0

    @staticmethod
    def aggregate(rows: int, groups: int) -> float:
        return (2 * rows + groups) * CPU

    def cost(self, plan: str, table: str, selectivity: float = 1.0) -> Cost:
        """Cost of reading a table by "SeqScan" or "IndexScan"; any other step has a flat cost."""
        stats = self.tables.get(table)
        if plan == "SeqScan":
            if stats is None:
                return Cost(100.0, 50.0, 0.0, 150.0)
            c = self.seq_scan(stats.row_count, stats.avg_row_size)
            return Cost(c, c * 0.5, 0.0, c * 1.5 * selectivity)
        if plan == "IndexScan":
            if stats is None:
                return Cost(50.0, 20.0, 0.0, 70.0)
            c = self.index_scan(0.1, stats.row_count)
            return Cost(c, c * 0.3, 0.0, c * 1.3)
        return Cost(10.0, 5.0, 0.0, 15.0)

    @staticmethod
    def can_use_index(column: str, operator: str, index_columns: list[str]) -> bool:
        """Whether ``column operator value`` can be looked up: its column comes first and it is an equality or a range."""
        return bool(index_columns) and index_columns[0] == column and operator in ("=", "<", "<=", ">", ">=")
