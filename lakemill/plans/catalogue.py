"""The registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.plans import engine_queries, select_queries
from lakemill.session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FLAGSHIP = """
SELECT l_returnflag, l_linestatus, COUNT(*) AS count_order, SUM(l_linenumber) AS sum_lines,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, MIN(l_extendedprice) AS min_price,
       MAX(l_extendedprice) AS max_price, AVG(l_linenumber) AS avg_line
FROM lineitem WHERE l_shipdate <= {stamp}'1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 0 ORDER BY l_returnflag, l_linestatus
"""


def select(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the engine over the test tables that it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, f"{sf_dir}/no-warehouse")
        for t in TABLES:
            if t in sql:
                e.attach(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        return e.execute(sql).df

    return run


flagship = select(FLAGSHIP.format(stamp="TIMESTAMP_NTZ"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {"flagship": flagship}
    out |= {k: select(sql) for k, (sql, _) in select_queries.QUERIES.items()}
    return out | {k: f for k, (f, _) in engine_queries.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {"flagship": FLAGSHIP.format(stamp="TIMESTAMP ").replace("SUM(l_linenumber)", "CAST(SUM(l_linenumber) AS BIGINT)")}
    out |= {k: oracle or sql for k, (sql, oracle) in select_queries.QUERIES.items()}
    return out | {k: sql for k, (_, sql) in engine_queries.QUERIES.items() if sql}
