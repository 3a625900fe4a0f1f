"""SQL type names, and column specifications of imports."""

from __future__ import annotations

import re

from pyspark.sql.types import StructType, _parse_datatype_string

from lakemill.errors import ParseError

#: The dialect's type names and what Spark stores them as.
SPARK_TYPES = {
    "BOOLEAN": "BOOLEAN",
    "BOOL": "BOOLEAN",
    "SMALLINT": "SMALLINT",
    "INTEGER": "INT",
    "INT": "INT",
    "BIGINT": "BIGINT",
    "REAL": "FLOAT",
    "FLOAT": "FLOAT",
    "DOUBLE": "DOUBLE",
    "DECIMAL": "DECIMAL",
    "NUMERIC": "DECIMAL",
    "CHAR": "STRING",
    "VARCHAR": "STRING",
    "TEXT": "STRING",
    "STRING": "STRING",
    "BINARY": "BINARY",
    "VARBINARY": "BINARY",
    "BLOB": "BINARY",
    "DATE": "DATE",
    "TIME": "STRING",
    "TIMESTAMP": "TIMESTAMP_NTZ",
    "JSON": "STRING",
    "UUID": "STRING",
}
NUMERIC = {"SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL"}


def spark_type(name: str, arguments: list[int] | None = None) -> tuple[str, int | None]:
    """(Spark's type, longest text): DECIMAL keeps its precision, CHAR and VARCHAR give the length to check."""
    found = SPARK_TYPES.get(name.upper())
    if found is None:
        raise ParseError(f"unknown type {name}")
    arguments = arguments or []
    if found == "DECIMAL":
        precision, scale = [*arguments, *([10, 0][len(arguments) :])][:2]
        return f"DECIMAL({precision},{scale})", None
    return found, arguments[0] if arguments and name.upper() in ("CHAR", "VARCHAR") else None


def is_numeric(type_: str) -> bool:
    return type_.split("(")[0] in NUMERIC


def is_string(type_: str) -> bool:
    return type_ == "STRING"


def is_binary(type_: str) -> bool:
    return type_ == "BINARY"


def is_temporal(type_: str) -> bool:
    return type_ in ("DATE", "TIMESTAMP_NTZ")


def import_schema(spec: str | list[tuple[str, str]]) -> StructType:
    """The schema of "name:type,name:type" or of (name, type) pairs."""
    if isinstance(spec, str):
        parts = [p.split(":") for p in re.split(r",(?![^()]*\))", spec)]
        if any(len(p) != 2 or not p[0].strip() for p in parts):
            raise ParseError(f"columns are given as name:type,...: {spec}")
        spec = [(a.strip(), b.strip()) for a, b in parts]
    fields = []
    for name, kind in spec:
        m = re.fullmatch(r"(\w+)(?:\(([\d,\s]+)\))?", kind)
        if not m:
            raise ParseError(f"unknown type {kind}")
        fields.append(f"`{name}` {spark_type(m[1], [int(x) for x in m[2].split(',')] if m[2] else None)[0]}")
    return _parse_datatype_string(", ".join(fields))
