"""Every registered engine query against its SQL in DuckDB, on the smallest test tables."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lakemill.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return v if isinstance(v, (str, bool)) or not hasattr(v, "__float__") else float(v)

    return sorted((str([value(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_imports_without_the_corpus_package():
    """In an interpreter that can't find the package or the pipeline, all engine queries are there and nothing else."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('lakemill.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "from lakemill.plans import catalogue\n"
        "assert set(e.queries()) == set(catalogue.queries()) and set(e.oracle_sql()) == set(catalogue.oracle_sql())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_every_engine_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
