"""The corpus operators as queries over the test tables: thin callers with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module that holds it, with ``query(spark, sf_dir)`` and, where SQL can express it, ``ORACLE``.
MODULES = {
    "op1_packing": "op1_packing",
    "op2_language_id": "op2_language_id",
    "op3_toxicity": "op3_toxicity",
    "op4_suffix_dedup": "op4_suffix_dedup",
    "op5_sharding": "op5_sharding",
    "op6_simhash": "op6_simhash",
    "op7_quality_rules": "op7_quality_rules",
    "op8_fingerprints": "op8_fingerprints",
    "op9_quality_classifier": "op9_quality_classifier",
    "op10_mixing": "op10_mixing",
}


def _module(name: str):
    return importlib.import_module(f"lakemill.llm.queries_{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE", None))}
