"""Checks of staged rows before a commit. Each is a declarative filter, aggregation or join that looks for one offender."""

from __future__ import annotations

import copy
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.catalog import State, Table
from lakemill.dialect import to_spark, tokens
from lakemill.errors import ConstraintViolation


def _none(rows: DataFrame, what: str) -> None:
    found = rows.limit(1).collect()
    if found:
        raise ConstraintViolation(f"{what}: {found[0].asDict()}")


def mentioned(expression: str) -> list[str]:
    """The words of an expression, the names of columns among them."""
    return [t.name for t in tokens(expression) if t.kind in ("word", "quoted")]


def check(spark: SparkSession, state: State, table: Table, new: DataFrame | None = None, columns: set[str] | None = None) -> None:
    """``new``: rows that a statement adds or rewrites, already part of the table in ``state``; None: all of its rows.

    ``columns``: what the statement assigned, in lower case, where it did nothing else; constraints on other columns
    can't break then. Doubles are looked for among the keys that ``new`` has, by a semi join, not in the whole table.
    A null in a key makes it differ from all others; CHECK holds where it isn't false.
    """

    def touched(names: list[str]) -> bool:
        return columns is None or any(n.lower() in columns for n in names)

    rows = table.read(spark) if new is None else new
    for c in table.columns:
        if not c.nullable and touched([c.name]):
            _none(rows.where(F.col(f"`{c.name}`").isNull()), f"{table.name}.{c.name} is NOT NULL")
        if c.length is not None and touched([c.name]):
            _none(rows.where(F.length(f"`{c.name}`") > c.length), f"{table.name}.{c.name} holds {c.length} characters")
    for k in table.constraints:
        if k.kind == "CHECK" and touched(mentioned(k.expression)):
            _none(rows.where(F.expr(f"NOT ({to_spark(k.expression)})")), f"CHECK ({k.expression}) of {table.name}")
        elif k.kind == "FOREIGN KEY" and touched(k.columns):
            other = state.table(k.table).read(spark)
            some = rows.dropna(subset=k.columns)
            on = [some[a].eqNullSafe(other[b]) for a, b in zip(k.columns, k.other_columns, strict=True)]
            _none(some.join(other, on, "left_anti"), f"{table.name} ({', '.join(k.columns)}) refers to no row of {k.table}")
    for names, where in table.unique_keys():
        if not touched([*names, *(mentioned(where) if where else [])]):
            continue
        keyed = (table.read(spark).where(to_spark(where)) if where else table.read(spark)).dropna(subset=names)
        if new is not None:
            keyed = keyed.join((new.where(to_spark(where)) if where else new).select(*names).distinct(), names, "left_semi")
        _none(keyed.groupBy(*names).count().where("count > 1"), f"{table.name} ({', '.join(names)}) is unique")


def check_change(spark: SparkSession, state: State, before: Table, table: Table) -> None:
    """Check all rows for what a change of the table's definition has added, and for nothing else."""
    part = copy.copy(table)
    old = {c.field: c for c in before.columns}
    part.columns = [c if c.field not in old else replace(c, length=None, nullable=c.nullable or not old[c.field].nullable) for c in table.columns]
    part.constraints = table.constraints[len(before.constraints) :]
    part.indexes = table.indexes[len(before.indexes) :]
    if part.constraints or part.indexes or any(not c.nullable or c.length is not None for c in part.columns):
        check(spark, state, part)


def check_referrers(spark: SparkSession, state: State, table: Table, gone: DataFrame, columns: set[str] | None = None) -> None:
    """Rows of other tables must not point to keys of ``gone`` rows that no row of ``table`` has any more.
    ``columns``: those that the statement assigned; keys without any of them are still there."""
    for other in state.tables.values():
        for k in other.constraints:
            if k.kind == "FOREIGN KEY" and k.table.lower() == table.name.lower():
                if columns is not None and not any(n.lower() in columns for n in k.other_columns):
                    continue
                left = table.read(spark).select(*k.other_columns)
                lost = gone.select(*k.other_columns).dropna().join(left, k.other_columns, "left_anti").distinct()
                lost = lost.toDF(*k.columns)
                _none(other.read(spark).join(lost, k.columns, "left_semi"), f"rows of {other.name} refer to {table.name}")
