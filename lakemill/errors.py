"""Error kinds. Analysis and run-time errors of queries are Spark's own exceptions."""


class EngineError(Exception):
    """Base of the engine's own errors."""


class ParseError(EngineError):
    """A statement that isn't in the dialect."""


class CatalogError(EngineError):
    """A table, column or index that is missing, or exists already."""


class ConstraintViolation(EngineError):
    """Rows that break a constraint; nothing is committed."""


class WriteConflict(EngineError):
    """Another commit has changed a table since the transaction began."""


class TransactionError(EngineError):
    """A transaction statement out of place."""


class ImportFailed(EngineError):
    """A file that doesn't fit the columns it is read into."""
