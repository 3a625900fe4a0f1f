"""INSERT, UPDATE and DELETE as copy-on-write: only files with affected rows are written anew."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.catalog import State, Table
from lakemill.dialect import Cursor, to_spark, tokens
from lakemill.errors import CatalogError, ParseError
from lakemill.operators.constraints import check, check_referrers
from lakemill.operators.sharding import range_shard
from lakemill.storage import Files


class Writer:
    """Writes staged data files of one statement."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.staged: list[str] = []

    def write(self, table: Table, rows: DataFrame) -> tuple[list[tuple[str, int]], int]:
        """(files, rows written) of ``rows``, which have the table's column names; by the table's ranges, if it has any.

        Ranges with bounds have files of their own, a large range several: adaptive execution splits and joins them.
        """
        path = f"{self.root}/data/{re.sub(r"\W", "_", table.name)}/{uuid.uuid4().hex}"
        out = rows.select(*(F.col(f"`{c.name}`").cast(c.type).alias(c.field) for c in table.columns))
        keys = [table.column(n).field for n in table.ranges]
        if table.bounds:
            kind = table.column(table.ranges[0]).type
            dealt = out.withColumn("_range", range_shard(F.col(keys[0]), [F.expr(to_spark(b)).cast(kind) for b in table.bounds]))
            dealt.hint("rebalance", "_range").sortWithinPartitions("_range", *keys).write.format(table.format).partitionBy("_range").save(path)
        else:
            if keys:
                out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
            out.write.format(table.format).save(path)
        written = self.spark.read.schema(table.stored_schema()).format(table.format).option("recursiveFileLookup", True).load(path)
        found = written.groupBy(F.col("_metadata.file_path").alias("path")).count().collect()  # a row a file
        return [(r["path"], table.schema_version) for r in sorted(found, key=lambda r: r["path"])], sum(r["count"] for r in found)

    def stage(self, rows: DataFrame) -> DataFrame:
        """``rows``, written and read back: evaluated once, for this statement only."""
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.staged.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clean(self) -> None:
        """Delete what stage() has written. For callers whose results don't read it any more."""
        for path in self.staged:
            Files(self.spark).delete(path)
        self.staged = []


def _numbered(spark: SparkSession, table: Table, writer: Writer, rows: DataFrame, name: str) -> DataFrame:
    """Nulls of the column replaced by numbers from its maximum on, without a global sort: rows are written, files
    are given ranges by their row counts, and a row's number is its place in its file."""
    top = table.read(spark).agg(F.max(name)).first()[0] or 0
    top = max(top, rows.agg(F.max(name)).first()[0] or 0)
    staged = writer.stage(rows)
    placed = staged.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    starts, at = [], top
    for r in sorted(placed.groupBy("_file").count().collect(), key=lambda r: r["_file"]):
        starts.append((r["_file"], at))
        at += r["count"]
    offsets = spark.createDataFrame(starts, "_file string, _start long")
    number = F.col("_start") + F.col("_row") + 1
    return placed.join(offsets, "_file").withColumn(name, F.coalesce(name, number.cast(table.column(name).type))).drop("_file", "_row", "_start")


def _values_with_defaults(c: Cursor, table: Table, columns: list[str]) -> str:
    """VALUES (...), ... as it stands, but for the word DEFAULT, which becomes the column's default."""
    c.expect("VALUES")
    rows = []
    while True:
        c.expect("(")
        row = []
        while True:
            text = c.text(",", ")")
            if text.upper() == "DEFAULT":
                if len(row) >= len(columns):
                    raise ParseError(f"more values than columns: {c.sql}")
                text = table.column(columns[len(row)]).default or "NULL"
            row.append(text)
            if not c.take(","):
                break
        c.expect(")")
        if len(row) != len(columns):
            raise ParseError(f"{len(row)} values for {len(columns)} columns: {c.sql}")
        rows.append("(" + ", ".join(row) + ")")
        if not c.take(","):
            break
    return "VALUES " + ", ".join(rows)


def full_rows(spark: SparkSession, table: Table, writer: Writer, rows: DataFrame, given: list[str]) -> DataFrame:
    """``rows`` with all of the table's columns by name, of its types: defaults and numbers where none is given."""
    known = {n.lower() for n in given}
    columns = []
    for c in table.columns:
        value = F.col(f"`{c.name}`") if c.name.lower() in known else F.expr(to_spark(c.default)) if c.default is not None else F.lit(None)
        columns.append(value.cast(c.type).alias(c.name))
    out = rows.select(*columns)
    for c in table.columns:
        if c.auto_increment:
            out = _numbered(spark, table, writer, out, c.name)
    return out.select(*(f"`{c.name}`" for c in table.columns))


def insert(spark: SparkSession, c: Cursor, state: State, writer: Writer, run) -> tuple[int, DataFrame | None]:
    """INSERT INTO t [(columns)] VALUES ... | query [ON CONFLICT (columns) DO NOTHING | DO UPDATE SET ...] [RETURNING ...].

    ``run``: gives the DataFrame of a query. EXCLUDED names the row that would have been inserted.
    """
    c.expect("INSERT", "INTO")
    table = writable(state, c.name())
    columns = [table.column(n).name for n in c.names()] if c.peek() == "(" and c.peek(1) != "SELECT" else [x.name for x in table.columns]
    query = _values_with_defaults(c, table, columns) if c.peek() == "VALUES" else c.text("ON", "RETURNING")
    rows = run(query)
    if len(rows.columns) != len(columns):
        raise ParseError(f"{len(rows.columns)} values for {len(columns)} columns: {c.sql}")
    rows = full_rows(spark, table, writer, rows.toDF(*columns), columns)
    conflict = None
    if c.take("ON", "CONFLICT"):
        keys = [table.column(n).name for n in c.names()]
        c.expect("DO")
        if c.take("NOTHING"):
            conflict = (keys, [])
        else:
            c.expect("UPDATE", "SET")
            conflict = (keys, _assignments(c, "RETURNING"))
    returning = c.text() if c.take("RETURNING") else None
    c.end()
    if conflict is not None:
        return upsert(spark, state, table, writer, rows, *conflict, returning)
    files, n = writer.write(table, rows)
    table.files += files
    new = table.read(spark, files)
    check(spark, state, table, new)
    return n, new.selectExpr(*_items(returning)) if returning else None


def writable(state: State, name: str) -> Table:
    table = state.table(name)
    if table.query is not None:
        raise CatalogError(f"{table.name} is a view")
    return table


def _items(text: str) -> list[str]:
    """The items of a RETURNING list."""
    depth, out, begin = 0, [], 0
    for t in tokens(text):
        depth += (t.text in "([") - (t.text in ")]") if t.kind == "mark" else 0
        if t.text == "," and depth == 0:
            out.append(text[begin : t.start])
            begin = t.end
    return [to_spark(x.strip()) for x in [*out, text[begin:]]]


def _assignments(c: Cursor, *until: str) -> list[tuple[str, str]]:
    out = []
    while True:
        name = c.name()
        c.expect("=")
        out.append((name, to_spark(c.text(",", *until))))
        if not c.take(","):
            return out


def upsert(spark: SparkSession, state: State, table: Table, writer: Writer, rows: DataFrame, keys: list[str], sets: list[tuple[str, str]], returning: str | None = None) -> tuple[int, DataFrame | None]:
    """Insert the rows whose keys are new and apply ``sets`` to the rows whose keys aren't; nothing for those if empty."""
    new = writer.stage(rows)
    check_double = new.dropna(subset=keys).groupBy(*keys).count().where("count > 1")
    if not check_double.isEmpty():
        raise ParseError(f"the statement has several rows of one key {keys}")
    present = table.read(spark)
    added = new.join(present.select(*keys).distinct(), keys, "left_anti")
    files, n = writer.write(table, added)
    touched: list[tuple[str, int]] = []
    gone = None
    if sets:
        old = table.read(spark, with_file=True)
        hit = [r["_file"] for r in old.join(new, keys, "left_semi").select("_file").distinct().collect()]  # a row a file
        if hit:
            old = gone = table.read(spark, [f for f in table.files if f[0] in set(hit)])
            excluded = new.select(*(F.col(f"`{c.name}`").alias(f"_new_{c.field}") for c in table.columns))
            on = [old[k] == excluded[f"_new_{table.column(k).field}"] for k in keys]
            matched = F.col(f"_new_{table.column(keys[0]).field}").isNotNull()
            values = {table.column(n).name: _excluded(table, e) for n, e in sets}
            merged = old.join(excluded, on, "left").select(*(F.when(matched, F.expr(values[c.name]).cast(c.type)).otherwise(F.col(f"`{c.name}`")).alias(c.name) if c.name in values else F.col(f"`{c.name}`") for c in table.columns))
            n += old.join(new, keys, "left_semi").count()
            touched, _ = writer.write(table, merged)
            table.files = [f for f in table.files if f[0] not in set(hit)]
    table.files += files + touched
    changed = table.read(spark, files + touched)
    if n:
        check(spark, state, table, changed)
    if gone is not None:
        check_referrers(spark, state, table, gone, {name.lower() for name, _ in sets})
    return n, changed.join(new.select(*keys), keys, "left_semi").select(*(c.name for c in table.columns)).selectExpr(*_items(returning)) if returning else None


def _excluded(table: Table, expression: str) -> str:
    """EXCLUDED.column as the column of the new row."""
    found, out, at, i = tokens(expression), [], 0, 0
    while i < len(found):
        t = found[i]
        if t.upper == "EXCLUDED" and i + 2 < len(found) and found[i + 1].text == ".":
            out += [expression[at : t.start], f"`_new_{table.column(found[i + 2].name).field}`"]
            at = found[i + 2].end
            i += 2
        i += 1
    return "".join([*out, expression[at:]])


def _hit_files(table: Table, spark: SparkSession, condition: SparkColumn) -> tuple[list[str], int]:
    """Files with rows for which the condition holds, and how many rows; one scan, of the condition's columns only."""
    rows = table.read(spark, with_file=True).where(condition).groupBy("_file").count().collect()  # a row a file
    return [r["_file"] for r in rows], sum(r["count"] for r in rows)


def _condition(c: Cursor, *until: str) -> SparkColumn:
    """WHERE; a null condition doesn't match."""
    return F.coalesce(F.expr(to_spark(c.text(*until))), F.lit(False)) if c.take("WHERE") else F.lit(True)


def update(spark: SparkSession, c: Cursor, state: State, writer: Writer, run) -> tuple[int, DataFrame | None]:
    """UPDATE t [[AS] alias] SET ... [FROM ...] [WHERE ...] [RETURNING ...]. ``run``: gives the DataFrame of a query."""
    c.expect("UPDATE")
    table = writable(state, c.name())
    c.take("AS")
    alias = c.name() if c.peek() != "SET" else table.name
    c.expect("SET")
    sets = {table.column(n).name: e for n, e in _assignments(c, "FROM", "WHERE", "RETURNING")}
    if c.take("FROM"):
        source = c.text("WHERE", "RETURNING")
        where = c.text("RETURNING") if c.take("WHERE") else "TRUE"
        returning = c.text() if c.take("RETURNING") else None
        c.end()
        return _update_from(spark, state, table, writer, run, alias, sets, source, where, returning)
    sets = {n: _unqualified(e, alias) for n, e in sets.items()}
    condition = F.coalesce(F.expr(to_spark(_unqualified(c.text("RETURNING"), alias))), F.lit(False)) if c.take("WHERE") else F.lit(True)
    returning = c.text() if c.take("RETURNING") else None
    c.end()
    hit, n = _hit_files(table, spark, condition)
    if not n:
        return 0, table.read(spark).limit(0).selectExpr(*_items(returning)) if returning else None
    old_files = [f for f in table.files if f[0] in set(hit)]
    old = table.read(spark, old_files).withColumn("_hit", condition)
    values = [(F.when(F.col("_hit"), F.expr(sets[x.name]).cast(x.type)).otherwise(F.col(f"`{x.name}`")) if x.name in sets else F.col(f"`{x.name}`")).alias(x.name) for x in table.columns]
    files, _ = writer.write(table, old.select(*values))
    gone = table.read(spark, old_files)
    table.files = [f for f in table.files if f[0] not in set(hit)] + files
    assigned = {x.lower() for x in sets}
    check(spark, state, table, table.read(spark, files), assigned)
    check_referrers(spark, state, table, gone, assigned)
    changed = old.where("_hit").select(*values)
    return n, changed.selectExpr(*_items(returning)) if returning else None


def _unqualified(expression: str, alias: str) -> str:
    """The expression without ``alias.`` before columns."""
    found, out, at = tokens(expression), [], 0
    for t, dot in zip(found, found[1:], strict=False):
        if t.kind in ("word", "quoted") and t.name.lower() == alias.lower() and dot.text == ".":
            out.append(expression[at : t.start])
            at = dot.end
    return "".join([*out, expression[at:]])


def _update_from(spark: SparkSession, state: State, table: Table, writer: Writer, run, alias: str, sets: dict[str, str], source: str, where: str, returning: str | None) -> tuple[int, DataFrame | None]:
    """Rows take their values from the row of ``source`` that they match; several for one row are an error. The matches
    are found once, by file and place in the file, and only files with matches are written anew."""
    name = f"_target_{uuid.uuid4().hex}"
    table.read(spark, with_file=True, with_row=True).createOrReplaceTempView(name)
    quoted = "`" + alias.replace("`", "``") + "`"
    values = ", ".join(f"{e} AS _set{i}" for i, e in enumerate(sets.values()))
    try:
        matched = writer.stage(run(f"SELECT {quoted}._file, {quoted}._row, {values} FROM {name} AS {quoted}, {source} WHERE {where}"))
    finally:
        spark.catalog.dropTempView(name)
    if not matched.groupBy("_file", "_row").count().where("count > 1").isEmpty():
        raise ParseError(f"a row of {table.name} matches several rows of {source}")
    counts = {r["_file"]: r["count"] for r in matched.groupBy("_file").count().collect()}  # a row a file
    if not counts:
        return 0, table.read(spark).limit(0).selectExpr(*_items(returning)) if returning else None
    old_files = [f for f in table.files if f[0] in counts]
    old = table.read(spark, old_files, with_file=True, with_row=True).join(matched.withColumn("_hit", F.lit(True)), ["_file", "_row"], "left")
    place = {n: f"_set{i}" for i, n in enumerate(sets)}
    values = [(F.when(F.col("_hit"), F.col(place[x.name]).cast(x.type)).otherwise(F.col(f"`{x.name}`")) if x.name in place else F.col(f"`{x.name}`")).alias(x.name) for x in table.columns]
    gone = table.read(spark, old_files)
    files, _ = writer.write(table, old.select(*values))
    table.files = [f for f in table.files if f[0] not in counts] + files
    assigned = {x.lower() for x in sets}
    check(spark, state, table, table.read(spark, files), assigned)
    check_referrers(spark, state, table, gone, assigned)
    return sum(counts.values()), old.where("_hit").select(*values).selectExpr(*_items(returning)) if returning else None


def truncate(spark: SparkSession, c: Cursor, state: State) -> int:
    """TRUNCATE [TABLE] t: all rows go, without a scan but for tables that refer to it."""
    c.take("TABLE")
    table = writable(state, c.name())
    c.end()
    gone = table.read(spark)
    table.files = []
    check_referrers(spark, state, table, gone)
    return 1


def delete(spark: SparkSession, c: Cursor, state: State, writer: Writer) -> tuple[int, DataFrame | None]:
    c.expect("DELETE", "FROM")
    table = writable(state, c.name())
    condition = _condition(c, "RETURNING")
    returning = c.text() if c.take("RETURNING") else None
    c.end()
    hit, n = _hit_files(table, spark, condition)
    gone = table.read(spark, [f for f in table.files if f[0] in set(hit)]).where(condition)
    if n:
        kept = table.read(spark, [f for f in table.files if f[0] in set(hit)]).where(~condition)
        files, left = writer.write(table, kept)
        table.files = [f for f in table.files if f[0] not in set(hit)] + (files if left else [])
        _referential_delete(spark, state, table, writer, gone)
    return n, gone.selectExpr(*_items(returning)) if returning else None


def _referential_delete(spark: SparkSession, state: State, table: Table, writer: Writer, gone: DataFrame) -> None:
    """ON DELETE of the tables that refer to the rows that went: cascade, set null or default, or an error. Of those
    tables, too, only files with rows that point there are written anew, and what is set is checked."""
    for other in state.tables.values():
        for k in [k for k in other.constraints if k.kind == "FOREIGN KEY" and k.table.lower() == table.name.lower()]:
            if k.on_delete not in ("CASCADE", "SET NULL", "SET DEFAULT"):
                continue
            keys = gone.select(*(F.col(f"`{a}`").alias(f"_{i}") for i, a in enumerate(k.other_columns))).dropna().distinct()
            on = [F.col(f"`{b}`") == F.col(f"_{i}") for i, b in enumerate(k.columns)]
            hit = {r["_file"] for r in other.read(spark, with_file=True).join(keys, on, "left_semi").select("_file").distinct().collect()}  # a row a file
            if not hit:
                continue
            rows = other.read(spark, [f for f in other.files if f[0] in hit])
            pointing, kept = rows.join(keys, on, "left_semi"), rows.join(keys, on, "left_anti")
            if k.on_delete != "CASCADE":
                blank = {b: F.expr(to_spark(other.column(b).default or "NULL")).cast(other.column(b).type) if k.on_delete == "SET DEFAULT" else F.lit(None).cast(other.column(b).type) for b in k.columns}
                kept = kept.unionByName(pointing.withColumns(blank))
            files, left = writer.write(other, kept)
            other.files = [f for f in other.files if f[0] not in hit] + (files if left else [])
            if k.on_delete == "CASCADE":
                _referential_delete(spark, state, other, writer, pointing)
            else:
                assigned = {b.lower() for b in k.columns}
                check(spark, state, other, other.read(spark, files), assigned)
                check_referrers(spark, state, other, pointing, assigned)
    check_referrers(spark, state, table, gone)
