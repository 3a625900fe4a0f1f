"""A SQL and data-processing engine on Spark: versioned tables, DDL and DML, statistics, prepared statements, import and export."""

from lakemill.errors import ConstraintViolation, EngineError, ParseError, WriteConflict
from lakemill.session import Engine, Result

__all__ = ["ConstraintViolation", "Engine", "EngineError", "ParseError", "Result", "WriteConflict"]
