"""Command line: statements, scripts, an interactive prompt, import and export."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from lakemill import config as settings
from lakemill.dialect import split
from lakemill.errors import EngineError
from lakemill.plans.cache import ResultCache
from lakemill.session import Engine, Result
from lakemill.sources import files as io

HELP = r"""Statements end with ;
\q or \quit     leave
\dt or \tables  list tables
\d NAME         columns of a table
\i FILE         run a script
\help           this text"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakemill", description=__doc__)
    p.add_argument("--config", action="append", default=[], help="a TOML file; may be given again")
    p.add_argument("--warehouse")
    commands = p.add_subparsers(dest="command", required=True)
    sql = commands.add_parser("sql", help="run statements")
    group = sql.add_mutually_exclusive_group()
    group.add_argument("--query", "-q")
    group.add_argument("--file", "-f")
    sql.add_argument("--limit", type=int, default=100, help="rows shown")
    for name in ("import", "export"):
        c = commands.add_parser(name, help=f"{name} a file")
        c.add_argument("--format", choices=["csv", "json", "ndjson"], default="csv")
        c.add_argument("--path", required=True)
        c.add_argument("--delimiter", default=",")
        c.add_argument("--no-header", action="store_true")
        if name == "import":
            c.add_argument("--table", required=True)
            c.add_argument("--columns", required=True, help="name:type,...")
            c.add_argument("--null-value", default="")
        else:
            c.add_argument("--query", required=True)
            c.add_argument("--null-value", default="NULL")
            c.add_argument("--pretty", action="store_true")
    return p


def show(result: Result, limit: int, out=print) -> None:
    if result.df is not None:
        out(io.console_table(result.df, limit))
    if result.changed is not None:
        out(f"{result.changed} row(s) affected")


def command(e: Engine, line: str, out=print) -> bool:
    """A \\ command of the prompt; False to leave."""
    word, _, rest = line.partition(" ")
    if word in ("\\q", "\\quit", "\\exit"):
        return False
    if word in ("\\dt", "\\tables"):
        out("\n".join(e.tables()) or "no tables")
    elif word == "\\d":
        out("\n".join(f"{f.name}  {f.dataType.simpleString()}" for f in e.table(rest.strip()).schema.fields))
    elif word == "\\i":
        for r in e.script(Path(rest.strip()).read_text()):
            show(r, 100, out)
    else:
        out(HELP)
    return True


def prompt(e: Engine, lines, limit: int, out=print) -> None:
    """Reads lines until a statement is complete; errors are shown and the prompt goes on."""
    held = ""
    for line in lines:
        try:
            if not held and line.strip().startswith("\\"):
                if not command(e, line.strip(), out):
                    return
                continue
            held += line if line.endswith("\n") else line + "\n"
            if held.rstrip().endswith(";"):
                text, held = held, ""
                for statement in split(text):
                    began = time.perf_counter()
                    show(e.execute(statement), limit, out)
                    out(f"{time.perf_counter() - began:.3f} s")
        except Exception as error:  # noqa: BLE001
            held = ""
            out(f"error: {str(error).splitlines()[0] if str(error) else type(error).__name__}")


def main(arguments: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    a = parser().parse_args(arguments)
    config = settings.load([Path.home() / ".lakemill.toml", "lakemill.toml", *a.config])
    builder = SparkSession.builder.appName("lakemill")
    for k, v in config.spark().items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    e = Engine(spark, a.warehouse or config.warehouse, ResultCache(config.cache_entries, config.cache_bytes, config.cache_seconds))
    try:
        if a.command == "sql":
            if a.query or a.file:
                for r in e.script(a.query or Path(a.file).read_text()):
                    show(r, a.limit)
            else:
                prompt(e, sys.stdin, a.limit)
        elif a.command == "import":
            if a.format == "csv":
                rows = io.import_csv(spark, a.path, a.columns, not a.no_header, a.delimiter, null_value=a.null_value)
            else:
                rows = io.import_json(spark, a.path, a.columns, lines=a.format == "ndjson")
            print(f"{e.append(a.table, rows)} row(s) imported")
        else:
            rows = e.execute(a.query).df
            if a.format == "csv":
                io.export_csv(rows, a.path, not a.no_header, a.delimiter, null_value=a.null_value)
            elif a.format == "json":
                io.export_json_array(rows, a.path, a.pretty)
            else:
                io.export_ndjson(rows, a.path)
    except EngineError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
