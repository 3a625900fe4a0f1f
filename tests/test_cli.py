import pytest

from lakemill import __main__ as cli
from lakemill.config import Config, load
from lakemill.errors import EngineError


def run(engine, *lines):
    out = []
    cli.prompt(engine, lines, 100, out.append)
    return out


def test_prompt(engine, tmp_path):
    out = run(engine, "CREATE TABLE t", "  (a INTEGER);", "INSERT INTO t VALUES (1), (2); SELECT SUM(a) AS s FROM t;", "\\dt", "\\d t", "\\help")
    text = "\n".join(out)
    assert "2 row(s) affected" in text and "│ 3 │" in text and "a  int" in text and cli.HELP in out and "t" in out
    (tmp_path / "s.sql").write_text("-- two\nINSERT INTO t VALUES (5);\nSELECT MAX(a) AS m FROM t")
    assert "│ 5 │" in "\n".join(run(engine, f"\\i {tmp_path}/s.sql"))
    assert run(engine, "SELECT nothing FROM t;")[0].startswith("error: ")
    assert run(engine, "\\q", "SELECT 1;") == []


def test_arguments():
    a = cli.parser().parse_args(["import", "--path", "x.csv", "--table", "t", "--columns", "a:INT"])
    assert a.format == "csv" and a.null_value == ""
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["sql", "--query", "x", "--file", "y"])


def test_config(tmp_path):
    assert load(env={}) == Config()
    (tmp_path / "a.toml").write_text('warehouse = "/w"\ncache_entries = 5\n')
    (tmp_path / "b.toml").write_text("cache_entries = 6\n")
    got = load([tmp_path / "a.toml", tmp_path / "missing.toml", tmp_path / "b.toml"], {"LAKEMILL_CACHE_SECONDS": "1.5", "OTHER": "x"})
    assert (got.warehouse, got.cache_entries, got.cache_seconds) == ("/w", 6, 1.5)
    for env in ({"LAKEMILL_NOTHING": "1"}, {"LAKEMILL_CACHE_ENTRIES": "x"}, {"LAKEMILL_CACHE_ENTRIES": "0"}, {"LAKEMILL_COMPRESSION": "zip"}):
        with pytest.raises(EngineError):
            load(env=env)
