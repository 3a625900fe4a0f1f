"""Helpers shared by the corpus operators: reading, the held-out split, scratch tables, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: \x20 and \x09-\x0D.
WS_CLASS = "[\\x20\\x09-\\x0D]"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lakemill-")
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")


def prepare(spark: SparkSession) -> None:
    """What every job here wants of a session: the package on its executors, and Arrow batches of 1,000 rows where
    the session leaves the default of 10,000, for texts are long rows and batches are held whole on both sides."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(*columns) if columns else docs


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset a temporary one, which only a
    local master's executors share: an error on any other."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lakemill-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lakemill/{uuid.uuid4().hex}/{name}"


#: Where durable() notes the paths that it writes, if a caller has asked for that; see scratch().
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)
#: Paths noted in the last scratch() block of a name and thread.
_LEFT: dict[tuple[int, str], list[str]] = {}


def durable(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: lineage ends there and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    if (noted := _NOTED.get()) is not None:
        noted.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame made by durable() once nothing will read them again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """A block whose scratch tables go when this thread begins the next block of that name: for callers that write each
    block's result before they begin the next, as a pipeline does with its stages. Scratch tables of other threads and
    names, and of results made outside such blocks, stay."""
    key = (threading.get_ident(), name)
    for path in _LEFT.pop(key, []):
        _delete(spark, path)
    _LEFT[key] = []
    token = _NOTED.set(_LEFT[key])
    try:
        yield
    finally:
        _NOTED.reset(token)


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a text column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of `column`; a single longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
