"""The engine: statements in, DataFrames and counts out."""

from __future__ import annotations

import copy
import itertools
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lakemill.catalog import Catalog, State, Table
from lakemill.dialect import Cursor, split, statement_type, to_spark, tokens
from lakemill.errors import CatalogError, EngineError, ParseError, TransactionError
from lakemill.operators import ddl, dml
from lakemill.operators.constraints import check, check_change
from lakemill.operators.index import IndexHandle, new_counts
from lakemill.plans.cache import ResultCache
from lakemill.plans.prepared import PreparedStatements


@dataclass
class Result:
    """``df``: the rows, lazily, or None where a statement returns none."""

    kind: str
    df: DataFrame | None = None
    changed: int | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    @property
    def affected_rows(self) -> int:
        """DDL: 1, or 0 if nothing was to do; DML: changed rows; queries: returned rows, which are counted now."""
        return self.changed if self.changed is not None else self.df.count() if self.df is not None else 0

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()] if self.df is not None else []


class Engine:
    """Tables below ``warehouse``, with SQL over them and over attached DataFrames.

    Statements commit one by one, or together between BEGIN and COMMIT; readers see the state their statement or
    transaction began with. Tables appear to Spark as temporary views of their names. ``format``: of the files of new
    tables, "parquet" or "orc". A transaction that has been open for ``transaction_seconds`` is rolled back at its next
    statement, or by cleanup().
    """

    def __init__(self, spark: SparkSession, warehouse: str, cache: ResultCache | None = None, format: str = "parquet", transaction_seconds: float | None = None, clock: Callable[[], float] = time.monotonic):
        if format not in ("parquet", "orc"):
            raise EngineError(f"unknown format {format}")
        self.spark, self.warehouse, self.format = spark, warehouse.rstrip("/"), format
        self.transaction_seconds, self.clock = transaction_seconds, clock
        self.catalog = Catalog(spark, self.warehouse)
        self.prepared = PreparedStatements()
        self.cache = cache
        self.attached: dict[str, DataFrame] = {}
        self.index_counts: dict[str, dict[str, int]] = {}
        self._numbers = itertools.count(1)
        self._attachment: dict[str, int] = {}
        self._began = 0.0
        self._base: State | None = None  # of the open transaction
        self._state: State | None = None
        self._isolation = "SNAPSHOT"
        self._pinned: set[int] = set()

    # State

    @property
    def state(self) -> State:
        return self._state if self._state is not None else self.catalog.load()

    @property
    def in_transaction(self) -> bool:
        return self._state is not None

    def tables(self) -> list[str]:
        return sorted([t.name for t in self.state.tables.values() if t.query is None] + list(self.attached))

    def views(self) -> list[str]:
        return sorted(t.name for t in self.state.tables.values() if t.query is not None)

    def table(self, name: str) -> DataFrame:
        """The rows of a table, a view or an attached DataFrame."""
        if name.lower() in self.attached:
            return self.attached[name.lower()]
        return self._rows(self.state, self.state.table(name), frozenset())

    def _rows(self, state: State, table: Table, above: frozenset[str]) -> DataFrame:
        if not table.is_view:
            return table.read(self.spark)
        if table.name.lower() in above:
            raise CatalogError(f"view {table.name} reads itself")
        return self._sql(table.query, None, state, above | {table.name.lower()}).toDF(*(c.name for c in table.columns))

    def schema(self, name: str) -> Table:
        return self.state.table(name)

    def attach(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame readable as a table; it can't be written to."""
        self.attached[name.lower()] = df
        self._attachment[name.lower()] = next(self._numbers)

    def read_at(self, name: str, version: int) -> DataFrame:
        """The table as of a catalog version."""
        return self.catalog.load(version).table(name).read(self.spark)

    def pin(self, version: int | None = None) -> int:
        """Keep a version, the latest by default, from garbage collection."""
        version = self.catalog.load(version).version
        self._pinned.add(version)
        return version

    def unpin(self, version: int) -> None:
        self._pinned.discard(version)

    def collect_garbage(self) -> int:
        """Drop versions that are neither the latest nor pinned nor read by the open transaction; how many."""
        return self.catalog.collect_garbage(self._pinned | ({self._base.version} if self._base else set()))

    # Statements

    def execute(self, sql: str, params: dict[str, Any] | list[Any] | None = None) -> Result:
        """Run one statement. ``params``: values for :name, or a list for $1, $2, ..."""
        statements = split(sql)
        if len(statements) != 1:
            raise ParseError(f"one statement is expected, not {len(statements)}")
        sql = statements[0]
        if isinstance(params, (list, tuple)):
            params = {f"p{i}": v for i, v in enumerate(params, 1)}
        kind = statement_type(sql)
        self._alive()
        if kind == "Query":
            return self._query(sql, params or {})
        if params:
            sql = _inlined(sql, params)
        if kind == "Transaction":
            return self._transaction(Cursor(sql))
        if kind == "Session":
            return self._session(Cursor(sql))
        return self._change(kind, sql)

    def script(self, text: str) -> list[Result]:
        """Run the statements of a script in order."""
        return [self.execute(s) for s in split(text)]

    def _query(self, sql: str, params: dict[str, Any]) -> Result:
        c = Cursor(sql)
        if c.take("SHOW", "TABLES"):
            return Result("Query", self.spark.createDataFrame([(t,) for t in self.tables()], "name string"))
        if c.take("SHOW", "VIEWS"):
            return Result("Query", self.spark.createDataFrame([(v,) for v in self.views()], "name string"))
        if c.take("SHOW", "INDEXES"):
            found = [(i.name, i.table, i.columns, i.unique, i.method) for t in self.state.tables.values() for i in t.indexes]
            return Result("Query", self.spark.createDataFrame(found, "name string, table string, columns array<string>, unique boolean, method string"))
        if self.cache is not None and not c.take("EXPLAIN"):
            key = self.cache.key(sql, params, self._versions(sql))
            hit = self.cache.get(key)
            if hit is None:
                df = self.sql(sql, params)
                hit = self.cache.put(key, df.schema, df)
            return Result("Query", self.spark.createDataFrame(hit.rows, hit.schema) if hit.rows is not None else hit.df)
        return Result("Query", self.sql(sql, params))

    def _versions(self, sql: str) -> dict[str, int]:
        """What a query's result depends on: versions of tables, also of those that its views read, and attachments."""
        state, found, left = self.state, {}, [sql]
        while left:
            for name in _words(left.pop()) - found.keys():
                if name in state.tables:
                    found[name] = state.tables[name].version
                    if state.tables[name].is_view:
                        left.append(state.tables[name].query)
                elif name in self._attachment:
                    found[name] = -self._attachment[name]
        return found

    def sql(self, sql: str, params: dict[str, Any] | None = None) -> DataFrame:
        """A query's DataFrame. Names of tables that occur in it are bound to views of this engine's state."""
        return self._sql(sql, params, self.state, frozenset())

    def _sql(self, sql: str, params: dict[str, Any] | None, state: State, above: frozenset[str]) -> DataFrame:
        bound = {n: self._rows(state, state.tables[n], above) if n in state.tables else self.attached[n] for n in _words(sql) if n in state.tables or n in self.attached}
        for name, rows in bound.items():  # all of them after the views among them, which bind the same names
            rows.createOrReplaceTempView(_quoted(name))
        return self.spark.sql(to_spark(sql), args=params or None)

    def fetch(self, sql: str, params: dict[str, Any] | list[Any] | None = None, timeout: float | None = None, max_rows: int | None = None, tag: str | None = None) -> list[tuple]:
        """A query's rows, ``max_rows`` at most. EngineError if it takes more than ``timeout`` seconds, or if cancel() is
        called with its ``tag``."""
        tag, stopped, done = tag or f"lakemill-{uuid.uuid4().hex}", threading.Event(), threading.Event()
        sc = self.spark.sparkContext

        def watch() -> None:
            if done.wait(timeout):
                return
            stopped.set()
            while not done.wait(0.2):  # a query is several jobs, and the next may only begin now
                sc.cancelJobsWithTag(tag)

        sc.addJobTag(tag)
        try:
            if timeout is not None:
                threading.Thread(target=watch, daemon=True).start()
            df = self.execute(sql, params).df
            return [tuple(r) for r in (df if max_rows is None else df.limit(max_rows)).collect()]
        except Exception as e:
            if stopped.is_set():
                raise EngineError(f"the query took more than {timeout} seconds") from e
            if "cancelled" in str(e).lower():
                raise EngineError("the query was cancelled") from e
            raise
        finally:
            done.set()
            sc.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        """Stop the jobs of the queries that fetch() runs under ``tag``."""
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def profile(self, sql: str, iterations: int = 3) -> list[float]:
        """Seconds of each of some runs of a query, whose rows go nowhere."""
        seconds = []
        for _ in range(iterations):
            began = time.perf_counter()
            self.sql(sql).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        return seconds

    def _change(self, kind: str, sql: str) -> Result:
        base = self._base if self.in_transaction else self.catalog.load()
        state = (self._state if self.in_transaction else base).copy()
        writer = dml.Writer(self.spark, self.warehouse)
        c, df = Cursor(sql), None
        if c.peek() == "INSERT":
            n, df = dml.insert(self.spark, c, state, writer, self.sql)
        elif c.peek() == "UPDATE":
            n, df = dml.update(self.spark, c, state, writer, self.sql)
        elif c.peek() == "DELETE":
            n, df = dml.delete(self.spark, c, state, writer)
        elif c.take("CREATE", "TABLE"):
            n = ddl.create_table(c, state, self.format)
        elif c.take("CREATE", "UNIQUE", "INDEX"):
            n = self._indexed(c, state, True)
        elif c.take("CREATE", "INDEX"):
            n = ddl.create_index(c, state, False)
        elif c.peek() == "CREATE":
            n = self._view(c, state, writer)
        elif c.take("REFRESH", "MATERIALIZED", "VIEW"):
            view = state.table(c.name())
            c.end()
            if not view.materialized:
                raise CatalogError(f"{view.name} is not a materialized view")
            n = self._filled(view, writer)
        elif c.take("DROP", "MATERIALIZED", "VIEW"):
            n = ddl.drop_view(c, state, True)
        elif c.take("DROP", "VIEW"):
            n = ddl.drop_view(c, state, False)
        elif c.take("TRUNCATE"):
            n = dml.truncate(self.spark, c, state)
        elif c.take("VACUUM"):
            if c.peek():
                state.table(c.name())
            c.end()
            return Result(kind, None, self.vacuum())
        elif c.take("DROP", "TABLE"):
            n = ddl.drop_table(c, state)
        elif c.take("DROP", "INDEX"):
            n = ddl.drop_index(c, state)
        elif c.take("ALTER", "TABLE"):
            before = copy.deepcopy(state.table(c.found[c.i].name))
            check_change(self.spark, state, before, ddl.alter_table(c, state))
            n = 1
        elif c.take("ANALYZE", "TABLE"):
            from lakemill.functions.statistics import Statistics

            name = c.name()
            exact = not c.take("ESTIMATE")
            c.end()
            return Result(kind, Statistics.collect({name: self.table(name)}, exact=exact).as_df(self.spark), 1)
        else:
            raise ParseError(f"unknown statement: {sql}")
        if self.in_transaction:
            self._state = state
        elif state != base:
            self.catalog.commit(base, state)
        if kind == "DML" and n:
            self._count(state, sql, n)
        if df is None:  # else the rows that the statement returns may still read it
            writer.clean()
        return Result(kind, df, n)

    def _count(self, state: State, sql: str, n: int) -> None:
        """Add what a statement changed to the counters of its table's indexes."""
        c = Cursor(sql)
        verb = c.next().upper
        if verb != "UPDATE":
            c.next()  # INTO or FROM
        for i in state.table(c.name()).indexes:
            counts = self.index_counts.setdefault(i.name.lower(), new_counts())
            counts["inserts"] += n if verb != "DELETE" else 0
            counts["deletes"] += n if verb != "INSERT" else 0

    def _indexed(self, c: Cursor, state: State, unique: bool) -> int:
        before = state.copy()
        n = ddl.create_index(c, state, unique)
        for name, t in state.tables.items():
            if len(t.indexes) > len(before.tables[name].indexes):
                check_change(self.spark, state, before.tables[name], t)
        return n

    def _view(self, c: Cursor, state: State, writer: dml.Writer) -> int:
        """CREATE [OR REPLACE] [MATERIALIZED] VIEW name [(columns)] AS query."""
        c.expect("CREATE")
        replace = c.take("OR", "REPLACE")
        materialized = c.take("MATERIALIZED")
        c.expect("VIEW")
        quiet = c.take("IF", "NOT", "EXISTS")
        name = c.name()
        names = c.names() if c.peek() == "(" else None
        c.expect("AS")
        query = c.text()
        c.end()
        if quiet and name.lower() in state.tables:
            return 0
        view = ddl.view(name, query, self.sql(query).schema, names, state, materialized, replace)
        if materialized:
            view.format = self.format
            self._filled(view, writer)
        else:
            self._rows(state, view, frozenset())  # a view that comes to read itself is an error now, not later
        return 1

    def _filled(self, view: Table, writer: dml.Writer) -> int:
        """Write a materialized view's rows anew; how many."""
        rows = self.sql(view.query).toDF(*(c.name for c in view.columns))
        view.files, n = writer.write(view, rows)
        return n

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Drop old versions as collect_garbage() does, and what statements that never ended have left: staged tables,
        and data files that no version lists, once they are ``older_than`` seconds old. How many versions went."""
        if self.in_transaction:
            raise TransactionError("VACUUM within a transaction")
        n = self.collect_garbage()
        self.catalog.sweep(older_than)
        return n

    def _transaction(self, c: Cursor) -> Result:
        if c.take("BEGIN") or c.take("START"):
            c.take("TRANSACTION")
            c.take("WORK")
            if c.take("ISOLATION", "LEVEL"):
                self._isolation = " ".join(t.upper for t in c.found[c.i :])
                if self._isolation not in ("READ UNCOMMITTED", "READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE", "SNAPSHOT"):
                    raise ParseError(f"unknown isolation level {self._isolation}")
                c.i = len(c.found)
            c.end()
            self.begin()
        elif c.take("COMMIT"):
            c.take("WORK")
            c.end()
            self.commit()
        else:
            c.expect("ROLLBACK")
            c.take("WORK")
            c.end()
            self.rollback()
        return Result("Transaction", None, 0)

    def begin(self) -> int:
        """Open a transaction on the latest version, which is returned. All isolation levels are snapshots."""
        self.cleanup()
        if self.in_transaction:
            raise TransactionError("a transaction is open")
        self._began = self.clock()
        self._base = self.catalog.load()
        self._state = self._base.copy()
        return self._base.version

    def commit(self) -> int:
        """Commit what the transaction did as one version; WriteConflict, and nothing is kept, if another was first."""
        self._alive()
        if not self.in_transaction:
            raise TransactionError("no transaction is open")
        base, state, self._base, self._state = self._base, self._state, None, None
        return self.catalog.commit(base, state).version if state != base else base.version

    def cleanup(self) -> bool:
        """Roll back a transaction that has been open for too long; whether there was one."""
        late = self.in_transaction and self.transaction_seconds is not None and self.clock() - self._began > self.transaction_seconds
        if late:
            self.rollback()
        return late

    def _alive(self) -> None:
        if self.cleanup():
            raise TransactionError(f"the transaction was open for more than {self.transaction_seconds} seconds and is rolled back")

    def rollback(self) -> None:
        """Forget what the transaction did, and delete the files that only it wrote."""
        if not self.in_transaction:
            raise TransactionError("no transaction is open")
        base, state, self._base, self._state = self._base, self._state, None, None
        known = {p for t in base.tables.values() for p, _ in t.files}
        for path in {p for t in state.tables.values() for p, _ in t.files} - known:
            self.catalog.files.delete(path)

    def _session(self, c: Cursor) -> Result:
        if c.take("PREPARE"):
            name = c.name()
            c.expect("AS")
            self.prepared.prepare(name, c.text())
            return Result("Session", None, 1)
        if c.take("DEALLOCATE"):
            self.prepared.deallocate(c.name())
            return Result("Session", None, 1)
        c.expect("EXECUTE")
        name, values = c.name(), []
        if c.take("("):
            while True:
                values.append(self.spark.sql(f"SELECT {to_spark(c.text(',', ')'))} AS v").first()[0])
                if not c.take(","):
                    break
            c.expect(")")
        c.end()
        return self.execute_prepared(name, values)

    def execute_prepared(self, name: str, values: list[Any]) -> Result:
        return self.execute(self.prepared.bind(name, values), list(values))

    # Indexes and layout

    def index(self, name: str) -> IndexHandle:
        for t in self.state.tables.values():
            for i in t.indexes:
                if i.name.lower() == name.lower():
                    return IndexHandle(i, t.read(self.spark), self.index_counts.setdefault(i.name.lower(), new_counts()))
        raise CatalogError(f"index {name} does not exist")

    def optimize(self, name: str, columns: list[str]) -> int:
        """Write a table anew in ranges of ``columns``, sorted, so that file and row-group statistics prune scans."""
        base = self.catalog.load()
        state = base.copy()
        table = state.table(name)
        rows = table.read(self.spark).repartitionByRange(*columns).sortWithinPartitions(*columns)
        table.files, n = dml.Writer(self.spark, self.warehouse).write(table, rows)
        self.catalog.commit(base, state)
        return n

    def append(self, name: str, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Insert the rows of a DataFrame, columns by name; absent ones get their defaults.

        ``batch``: a stream's name and the number of its micro-batch; the number is committed with the rows, and a
        batch that has been committed before does nothing.
        """
        base = self._base if self.in_transaction else self.catalog.load()
        state = (self._state if self.in_transaction else base).copy()
        table = dml.writable(state, name)
        if batch is not None:
            if table.batches.get(batch[0], -1) >= batch[1]:
                return 0
            table.batches[batch[0]] = batch[1]
        writer = dml.Writer(self.spark, self.warehouse)
        rows = dml.full_rows(self.spark, table, writer, df, df.columns)
        files, n = writer.write(table, rows)
        table.files += files
        check(self.spark, state, table, table.read(self.spark, files))
        if self.in_transaction:
            self._state = state
        else:
            self.catalog.commit(base, state)
        writer.clean()
        return n


def _words(sql: str) -> set[str]:
    """Words of a statement in lower case, the names of tables among them."""
    return {t.name.lower() for t in tokens(sql) if t.kind in ("word", "quoted")}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _inlined(sql: str, params: dict[str, Any]) -> str:
    """Parameters as literals, for statements that Spark doesn't parse whole."""
    found, out, at = tokens(sql), [], 0
    for i, t in enumerate(found):
        name, start = None, t.start
        if t.kind == "parameter":
            name = f"p{t.text[1:]}"
        elif t.kind == "word" and i and found[i - 1].text == ":" and found[i - 1].end == t.start:
            name, start = t.text, found[i - 1].start
        if name is not None:
            if name not in params:
                raise ParseError(f"no value for parameter {t.text}")
            out += [sql[at:start], literal(params[name])]
            at = t.end
    return "".join([*out, sql[at:]])


def literal(value: Any) -> str:
    import datetime
    import decimal

    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return f"X'{value.hex()}'"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE'{value.isoformat()}'"
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
