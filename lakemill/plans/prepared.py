"""Prepared statements with $1, $2, ... as parameters."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from lakemill.dialect import tokens
from lakemill.errors import EngineError


@dataclass
class Prepared:
    sql: str
    parameters: int
    executions: int = 0


class PreparedStatements:
    def __init__(self):
        self._by_id: dict[str, Prepared] = {}

    def prepare(self, id_: str, sql: str) -> str:
        """Parameters are counted once however often they occur; they must be numbered from 1 without a gap."""
        if id_ in self._by_id:
            raise EngineError(f"prepared statement {id_} exists")
        used = {int(t.text[1:]) for t in tokens(sql) if t.kind == "parameter"}
        if used != set(range(1, len(used) + 1)):
            raise EngineError(f"parameters must be $1 to ${len(used)}")
        self._by_id[id_] = Prepared(sql, len(used))
        return id_

    def get(self, id_: str) -> Prepared:
        if id_ not in self._by_id:
            raise EngineError(f"prepared statement {id_} does not exist")
        return self._by_id[id_]

    def bind(self, id_: str, values: list[Any]) -> str:
        """The statement's text, its values checked in number and its executions counted."""
        p = self.get(id_)
        if len(values) != p.parameters:
            raise EngineError(f"{id_} takes {p.parameters} parameters, not {len(values)}")
        p.executions += 1
        return p.sql

    def list(self) -> list[str]:
        return sorted(self._by_id)

    def deallocate(self, id_: str) -> None:
        self.get(id_)
        del self._by_id[id_]
