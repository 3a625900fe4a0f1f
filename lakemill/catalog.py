"""The persistent catalog: tables with their columns, constraints, indexes and files, one immutable file a version."""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from lakemill.errors import CatalogError, WriteConflict
from lakemill.storage import Files


@dataclass
class Column:
    """``field``: the name in the files, which a rename leaves alone. ``since``: the schema version that added it;
    rows of older files read as ``initial``, the default it had then."""

    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    auto_increment: bool = False
    length: int | None = None
    field: str = ""
    since: int = 0
    initial: str | None = None


@dataclass
class Constraint:
    """kind: PRIMARY KEY, UNIQUE, CHECK or FOREIGN KEY."""

    kind: str
    columns: list[str] = field(default_factory=list)
    expression: str | None = None
    table: str | None = None
    other_columns: list[str] = field(default_factory=list)
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    name: str = ""


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]
    unique: bool = False
    method: str = "BTREE"
    where: str | None = None


@dataclass
class Table:
    """``files``: (path, schema version when written). ``version`` changes with every commit to the table.
    ``batches``: the last micro-batch of each stream that was committed. ``query``: of a view, whose rows are in files
    only if it is ``materialized``. ``ranges``: columns by whose ranges rows are dealt to files, and ``bounds`` between
    the ranges of the one column, as SQL, where they are given."""

    name: str
    columns: list[Column]
    constraints: list[Constraint] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    files: list[tuple[str, int]] = field(default_factory=list)
    schema_version: int = 0
    version: int = 0
    next_field: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    query: str | None = None
    materialized: bool = False
    ranges: list[str] = field(default_factory=list)
    bounds: list[str] = field(default_factory=list)
    format: str = "parquet"

    @property
    def is_view(self) -> bool:
        return self.query is not None and not self.materialized

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise CatalogError(f"table {self.name} has no column {name}")

    def add(self, column: Column) -> None:
        if any(c.name.lower() == column.name.lower() for c in self.columns):
            raise CatalogError(f"table {self.name} has a column {column.name}")
        column.field, column.since, column.initial = f"f{self.next_field}", self.schema_version, column.default
        self.next_field += 1
        self.columns.append(column)

    def schema(self) -> StructType:
        return _parse_datatype_string(", ".join(f"`{c.name}` {c.type}" for c in self.columns))

    def stored_schema(self) -> StructType:
        return _parse_datatype_string(", ".join(f"`{c.field}` {c.type}" for c in self.columns))

    def read(self, spark: SparkSession, files: list[tuple[str, int]] | None = None, with_file: bool = False, with_row: bool = False) -> DataFrame:
        """The rows, a scan for each schema version whose columns differ by defaults; else one scan of all files.
        With their file as _file, and their place in it as _row, if asked for."""
        if self.is_view:
            raise CatalogError(f"{self.name} is a view")
        if with_row and self.format != "parquet":
            raise CatalogError(f"rows of {self.format} files have no numbers")
        files = self.files if files is None else files
        extra = {"_file": "file_path"} if with_file else {}
        extra |= {"_row": "row_index"} if with_row else {}
        if not files:
            return spark.createDataFrame([], self.schema()).withColumns({k: F.lit(None).cast("string" if k == "_file" else "long") for k in extra})
        late = [c for c in self.columns if c.initial is not None]
        groups: dict[tuple[str, ...], list[str]] = {}
        for path, version in files:
            groups.setdefault(tuple(c.name for c in late if c.since > version), []).append(path)
        out = None
        for missing, paths in groups.items():
            rows = spark.read.schema(self.stored_schema()).format(self.format).load(paths)
            columns = [(F.expr(c.initial).cast(c.type) if c.name in missing else F.col(c.field)).alias(c.name) for c in self.columns]
            part = rows.select(*columns, *(F.col(f"_metadata.{v}").alias(k) for k, v in extra.items()))
            out = part if out is None else out.unionByName(part)
        return out

    def unique_keys(self) -> list[tuple[list[str], str | None]]:
        """(columns, condition on the rows that they tell apart or None for all rows)."""
        keys = [(c.columns, None) for c in self.constraints if c.kind in ("PRIMARY KEY", "UNIQUE")]
        return keys + [(i.columns, i.where) for i in self.indexes if i.unique]


def _table(d: dict) -> Table:
    d = dict(d)
    d["columns"] = [Column(**c) for c in d["columns"]]
    d["constraints"] = [Constraint(**c) for c in d["constraints"]]
    d["indexes"] = [Index(**i) for i in d["indexes"]]
    d["files"] = [tuple(f) for f in d["files"]]
    return Table(**d)


@dataclass
class State:
    version: int
    tables: dict[str, Table]

    def table(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise CatalogError(f"table {name} does not exist")
        return self.tables[name.lower()]

    def copy(self) -> State:
        return copy.deepcopy(self)


class Catalog:
    """Versions of the catalog below ``root``. Readers keep a State, which no later commit changes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _path(self, version: int) -> str:
        return f"{self.root}/catalog/v{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.files.names(f"{self.root}/catalog") if n.startswith("v") and n.endswith(".json")]

    def load(self, version: int | None = None) -> State:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return State(0, {})
        d = json.loads(self.files.read(self._path(version)))
        return State(version, {k: _table(t) for k, t in d["tables"].items()})

    def commit(self, base: State, changed: State) -> State:
        """Put the tables that differ between ``base`` and ``changed`` on top of the latest version.

        First writer wins: WriteConflict if another commit has touched one of those tables since ``base``.
        """
        names = {n for n in {*base.tables, *changed.tables} if base.tables.get(n) != changed.tables.get(n)}
        while True:
            latest = self.load()
            for n in names:
                if latest.version != base.version and latest.tables.get(n) != base.tables.get(n):
                    raise WriteConflict(f"table {n} was changed by another commit")
            tables = {k: t for k, t in latest.tables.items() if k not in names}
            for n in names & set(changed.tables):
                tables[n] = copy.deepcopy(changed.tables[n])
                tables[n].version = latest.version + 1
            new = State(latest.version + 1, tables)
            if self.files.create(self._path(new.version), json.dumps({"tables": {k: asdict(t) for k, t in tables.items()}})):
                return new

    def collect_garbage(self, pinned: set[int] = frozenset()) -> int:
        """Drop all versions but the latest and the pinned ones, and the data files that only those listed."""
        versions = self.versions()
        keep = {max(versions, default=0), *pinned}
        listed = {p for v in keep & {0, *versions} for t in self.load(v).tables.values() for p, _ in t.files}
        old = [v for v in versions if v not in keep]
        gone = {p for v in old for t in self.load(v).tables.values() for p, _ in t.files} - listed
        for path in [*map(self._path, old), *sorted(gone)]:
            self.files.delete(path)
        return len(old)

    def sweep(self, older_than: float) -> int:
        """Delete staged tables and data folders of which no version lists a file, if nothing has been written to them
        for ``older_than`` seconds; how many. Statements that are still running are thought to be younger."""
        below = f"{self.root.rpartition('/')[2]}/data/"  # paths in the catalog begin with a scheme, the root may not
        listed = {p.partition(below)[2] for v in self.versions() for t in self.load(v).tables.values() for p, _ in t.files}
        used = {"/".join(p.split("/")[:2]) for p in listed}
        found = [f"{self.root}/staged/{n}" for n in self.files.names(f"{self.root}/staged")]
        for table in self.files.names(f"{self.root}/data"):
            found += [f"{self.root}/data/{table}/{n}" for n in self.files.names(f"{self.root}/data/{table}") if f"{table}/{n}" not in used]
        old = [p for p in found if self.files.age(p) > older_than]
        for p in old:
            self.files.delete(p)
        return len(old)
