"""Import from CSV and JSON, export to CSV, JSON arrays and JSON lines, console tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

from lakemill.errors import ImportFailed
from lakemill.storage import Files
from lakemill.types import import_schema

#: The words that an import takes for true and false, in any case.
TRUE = ("true", "t", "yes", "y", "1")
FALSE = ("false", "f", "no", "n", "0")


def import_csv(spark: SparkSession, path: str, columns: str | list[tuple[str, str]], header: bool = True, delimiter: str = ",", quote: str = '"', skip_rows: int = 0, null_value: str = "", multiline: bool = True) -> DataFrame:
    """A CSV file with the columns of a specification ("name:type,..."). Empty fields and ``null_value`` are null.

    Every row must have a field for each column, of its type: ImportFailed, raised as the rows are read, if not.
    ``skip_rows`` rows after the header are left out, of one file, by their place in its first partition.
    Quoted fields may hold line breaks; ``multiline=False`` is for files that have none, which Spark then reads in
    parallel parts, where it otherwise has one task for each file.
    """
    schema = import_schema(columns)
    # Fields are read as text and cast, so that a bad value and a wrong number of fields are told apart from nulls.
    raw = StructType([*(StructField(f.name, StringType()) for f in schema.fields), StructField("_corrupt", StringType())])
    rows = (
        spark.read.schema(raw)
        .option("header", header and not skip_rows).option("sep", delimiter).option("quote", quote).option("escape", quote)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multiline).option("enforceSchema", True)
        .csv(path)
    )
    first = skip_rows + int(header)
    if skip_rows:
        rows = rows.withColumn("_at", F.col("_metadata.file_block_start")).withColumn("_n", F.monotonically_increasing_id())
        # Within the file's first block, whose rows are numbered without gaps from its partition's start.
        start = rows.where("_at = 0").agg(F.min("_n")).first()[0] or 0
        rows = rows.where((F.col("_at") != 0) | (F.col("_n") >= start + first)).drop("_at", "_n")
    bad = F.raise_error(F.concat(F.lit("a row has a wrong number of fields: "), F.col("_corrupt")))
    out = []
    for f in schema.fields:
        text = F.col(f"`{f.name}`")
        text = F.when((text == "") | (text == null_value), None).otherwise(text)
        value = text.cast(f.dataType)
        if isinstance(f.dataType, BooleanType):
            word = F.lower(text)
            value = F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))
        out.append(F.when(F.col("_corrupt").isNotNull(), bad.cast(f.dataType)).otherwise(value).alias(f.name))
    return rows.select(*out)


def import_json(spark: SparkSession, path: str, columns: str | list[tuple[str, str]], lines: bool = False) -> DataFrame:
    """A JSON file: an array of objects or one object, or with ``lines`` one object a line. A key that is missing is null."""
    return spark.read.schema(import_schema(columns)).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def checked(df: DataFrame) -> DataFrame:
    """``df`` after a pass that raises ImportFailed where a row is bad."""
    try:
        df.foreachPartition(lambda rows: [None for _ in rows] and None)
    except Exception as e:
        raise ImportFailed(str(e).split("\n")[0]) from e
    return df


def _printable(df: DataFrame, hex_binary: bool) -> DataFrame:
    """Binary as 0x and hex digits, or as base64."""
    return df.select(*((F.concat(F.lit("0x"), F.lower(F.hex(f"`{f.name}`"))) if hex_binary else F.base64(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, BinaryType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def export_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", quote: str = '"', null_value: str = "NULL") -> None:
    """A folder of CSV files, written by the executors. Quotes in fields are doubled; binary is 0x and hex digits."""
    _printable(df, True).write.option("header", header).option("sep", delimiter).option("quote", quote).option("escape", quote).option("nullValue", null_value).option("emptyValue", "").csv(path)


def export_ndjson(df: DataFrame, path: str) -> None:
    """A folder of files with one JSON object a line, nulls written out; binary is base64."""
    _printable(df, False).write.option("ignoreNullFields", False).json(path)


def export_json_array(df: DataFrame, path: str, pretty: bool = False) -> int:
    """One file with a JSON array, for results that one file is meant for: rows stream through the driver, a
    partition at a time. Returns the rows written."""
    rows = _printable(df, False).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    files, n = Files(df.sparkSession), 0
    fs, p = files._at(path)
    out = fs.create(p, True)
    try:
        out.write(b"[")
        for r in rows.toLocalIterator():
            text = json.dumps(json.loads(r["j"]), ensure_ascii=False, indent=2).replace("\n", "\n  ") if pretty else r["j"]
            out.write(((",\n  " if n else "\n  ") if pretty else ("," if n else "")).encode() + text.encode())
            n += 1
        out.write(b"\n]\n" if pretty and n else b"]\n")
    finally:
        out.close()
    return n


def pages(df: DataFrame, size: int) -> Iterator[tuple[list[tuple], bool]]:
    """(rows, whether more follow), ``size`` rows at a time, without collecting the whole result."""
    held: list[tuple] = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        if len(held) == size:
            yield held, True
            held = []
        held.append(tuple(r))
    yield held, False


def console_table(df: DataFrame, limit: int = 100) -> str:
    """The first ``limit`` rows as a table of text; null is NULL, binary is <binary:length>."""

    def cell(v) -> str:
        return "NULL" if v is None else f"<binary:{len(v)}>" if isinstance(v, (bytes, bytearray)) else str(v)

    rows = [[cell(v) for v in r] for r in df.limit(limit).collect()]
    widths = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
    line = lambda left, mid, right: left + mid.join("─" * (w + 2) for w in widths) + right
    text = lambda cells: "│" + "│".join(f" {c:<{w}} " for c, w in zip(cells, widths, strict=True)) + "│"
    return "\n".join([line("╭", "┬", "╮"), text(df.columns), line("├", "┼", "┤"), *map(text, rows), line("╰", "┴", "╯")])
