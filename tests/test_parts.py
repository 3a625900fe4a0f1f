import json

import pytest

from lakemill.dialect import split, statement_type, to_spark
from lakemill.errors import EngineError, ImportFailed, ParseError
from lakemill.functions import mvcc
from lakemill.functions.statistics import Statistics, histogram
from lakemill.plans.cache import ResultCache
from lakemill.plans.prepared import PreparedStatements
from lakemill.sources import files as io
from lakemill.types import import_schema, is_binary, is_numeric, is_string, is_temporal, spark_type


def test_split():
    assert split("-- c\nSELECT *\nFROM users\n\nWHERE age > 18;\nINSERT INTO t VALUES (';')") == ["SELECT *\nFROM users\n\nWHERE age > 18", "INSERT INTO t VALUES (';')"]
    assert split("SELECT 1 -- ; no\n + 1;; ;") == ["SELECT 1  \n + 1"]
    assert split(" -- nothing\n") == []


def test_statement_type():
    assert [statement_type(s) for s in ("select 1", "(SELECT 1)", "insert into t", "CREATE TABLE t", "BEGIN", "PREPARE x")] == ["Query", "Query", "DML", "DDL", "Transaction", "Session"]
    for bad in ("", "FROBNICATE"):
        with pytest.raises(ParseError):
            statement_type(bad)


def test_to_spark():
    assert to_spark('SELECT "a""b", \'"\' FROM t WHERE x = $1') == "SELECT `a\"b`, '\"' FROM t WHERE x = :p1"
    assert to_spark("SELECT CAST(text AS TEXT), CAST(a AS VARCHAR(3)), CAST(b AS VARCHAR), text AS text") == "SELECT CAST(text AS STRING), CAST(a AS VARCHAR(3)), CAST(b AS STRING), text AS text"


def test_types(spark):
    assert spark_type("varchar", [5]) == ("STRING", 5) and spark_type("NUMERIC", [8, 2]) == ("DECIMAL(8,2)", None)
    assert is_numeric("DECIMAL(8,2)") and is_string("STRING") and is_binary("BINARY") and is_temporal("DATE") and not is_numeric("STRING")
    assert import_schema("a:INTEGER, b:DECIMAL(10,2),c:TEXT").simpleString() == "struct<a:int,b:decimal(10,2),c:string>"
    for bad in ("a", "a:NOPE", ":INT"):
        with pytest.raises(ParseError):
            import_schema(bad)


def test_csv_import(spark, tmp_path):
    def read(text, columns, **options):
        p = tmp_path / f"{abs(hash((text, columns)))}.csv"
        p.write_text(text)
        return [tuple(r) for r in io.import_csv(spark, str(p), columns, **options).collect()]

    assert read("id,name,age\n1,Alice,30\n2,Bob,25\n", "id:INTEGER,name:VARCHAR,age:INTEGER") == [(1, "Alice", 30), (2, "Bob", 25)]
    assert read("1,Alice\n2,Bob\n", "id:INTEGER,name:TEXT", header=False) == [(1, "Alice"), (2, "Bob")]
    assert read("id;name\n1; Alice \n", "id:INTEGER,name:TEXT", delimiter=";") == [(1, "Alice")]
    assert read('id,n,t\n1,"John ""J"" Doe","A person with a, comma"\n', "id:INTEGER,n:TEXT,t:TEXT") == [(1, 'John "J" Doe', "A person with a, comma")]
    assert read("id,name,age\n1,Alice,\n2,NULL,3\n", "id:INTEGER,name:TEXT,age:INTEGER", null_value="NULL") == [(1, "Alice", None), (2, None, 3)]
    assert read("a,b\nx,x\n1,YES\n2,f\n3,\n", "a:INTEGER,b:BOOLEAN", skip_rows=1) == [(1, True), (2, False), (3, None)]
    for bad in ("id,name\n1\n", "id,name\n1,a,b\n", "id,name\nx,a\n"):
        with pytest.raises(Exception):  # noqa: B017
            read(bad, "id:INTEGER,name:TEXT")
    p = tmp_path / "bad.csv"
    p.write_text("a\nmaybe\n")
    with pytest.raises(ImportFailed):
        io.checked(io.import_csv(spark, str(p), "a:BOOLEAN"))


def test_json_import(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"id":1,"name":"Alice","age":30},{"id":2,"name":"Bob"}]')
    assert [tuple(r) for r in io.import_json(spark, str(p), "id:INTEGER,name:TEXT,age:INTEGER").collect()] == [(1, "Alice", 30), (2, "Bob", None)]
    p.write_text('{"id":1,"name":"Alice"}')
    assert [tuple(r) for r in io.import_json(spark, str(p), "id:INTEGER,name:TEXT").collect()] == [(1, "Alice")]
    p.write_text('[{"id":{"nested":1}}]')
    with pytest.raises(Exception):  # noqa: B017
        io.import_json(spark, str(p), "id:INTEGER").collect()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', bytearray(b"\x01\x02")), (2, "8 chars!", None)], "id int, name string, b binary").coalesce(1)
    for pretty in (False, True):
        path = str(tmp_path / f"{pretty}.json")
        assert io.export_json_array(df, path, pretty) == 2
        text = open(path).read()
        assert json.loads(text) == [{"id": 1, "name": 'a"b', "b": "AQI="}, {"id": 2, "name": "8 chars!", "b": None}]
        assert ("\n  " in text) == pretty
    assert io.export_json_array(df.limit(0), str(tmp_path / "none.json")) == 0 and json.loads(open(tmp_path / "none.json").read()) == []
    io.export_csv(df, str(tmp_path / "out.csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out.csv").glob("part-*")))
    assert text == 'id,name,b\n1,"a""b",0x0102\n2,8 chars!,NULL\n'
    io.export_csv(df.select("id"), str(tmp_path / "plain.csv"), header=False)
    assert "".join(p.read_text() for p in sorted((tmp_path / "plain.csv").glob("part-*"))) == "1\n2\n"
    table = io.console_table(df)
    assert "<binary:2>" in table and "NULL" in table and "8 chars!" in table


def test_pages(spark):
    df = spark.range(5).repartition(2)
    got = list(io.pages(df, 2))
    assert [len(r) for r, _ in got] == [2, 2, 1] and [m for _, m in got] == [True, True, False]
    assert list(io.pages(spark.range(0), 2)) == [([], False)]


def test_prepared_statements():
    p = PreparedStatements()
    p.prepare("a", "SELECT * FROM t WHERE x = $1 AND y = '$2'")
    assert p.get("a").parameters == 1 and p.list() == ["a"]
    assert p.bind("a", [1]) and p.get("a").executions == 1
    for f in (lambda: p.prepare("a", "SELECT 1"), lambda: p.bind("a", []), lambda: p.get("b"), lambda: p.prepare("c", "SELECT $2")):
        with pytest.raises(EngineError):
            f()
    p.deallocate("a")
    assert p.list() == []


def test_cache_policies(spark):
    now = [0.0]
    df = spark.createDataFrame([(1,)], "a int")
    c = ResultCache(max_entries=2, ttl=10, clock=lambda: now[0])
    for k in "ab":
        c.put(k, df.schema, df)
    c.get("a")
    c.put("c", df.schema, df)
    assert c.get("b") is None and c.get("a") is not None
    now[0] = 11
    assert c.get("a") is None
    small = ResultCache(max_bytes=1)
    assert small.put("a", df.schema, df).rows is None and len(small) == 0
    few = ResultCache(max_rows=1)
    assert few.put("a", df.schema, spark.range(3)).rows is None
    fifo = ResultCache(max_entries=2, policy="fifo")
    for k in "ab":
        fifo.put(k, df.schema, df)
    fifo.get("a")
    fifo.put("c", df.schema, df)
    assert fifo.get("a") is None and fifo.remove("b") and not fifo.remove("b")
    fifo.clear()
    assert fifo.size == 0


def test_statistics(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "abcde"[i % 5]) for i in range(1000)], "n int, status string")
    s = Statistics.collect({"t": df})
    t = s.tables["t"]
    assert t.row_count == 1000 and t.columns["status"].null_count == 250 and t.columns["n"].max_value == 999
    assert sum(n for _, _, n in t.columns["n"].histogram) == 1000
    assert s.selectivity("t", "status", "=") == 1 / 5 and s.rows("t", 0.2) == 200
    assert s.selectivity("t", "status", "<") == 0.33 and s.selectivity("t", "x", "=") == 0.5 and s.rows("nothing") == 1000
    assert s.selectivity("t", "status", "!=") == 0.8
    assert Statistics.both(0.5, 0.5) == 0.25 and Statistics.either(0.5, 0.5) == 0.75
    assert Statistics.sort(0) == 0 and Statistics.sort(8) == pytest.approx(0.24)
    assert s.cost("SeqScan", "missing").total == 150 and s.cost("IndexScan", "missing").total == 70 and s.cost("Sort", "t").total == 15
    assert s.cost("SeqScan", "t", 0.5).total == pytest.approx(s.cost("SeqScan", "t").cpu * 0.75)
    assert Statistics.can_use_index("a", ">=", ["a", "b"]) and not Statistics.can_use_index("b", "=", ["a", "b"]) and not Statistics.can_use_index("a", "!=", ["a"])
    assert {r.bucket: r.row_count for r in histogram(df, "n", 100, 5).collect()} == {0: 100, 1: 100, 2: 100, 3: 100, 4: 600}
    assert Statistics.collect({"e": df.limit(0)}).tables["e"].row_count == 0


def test_versions_and_conflicts(spark):
    v = spark.createDataFrame(
        [("a", "1", 1, True, False), ("a", "2", 5, True, False), ("a", "3", 9, False, False), ("b", "1", 2, True, False), ("b", None, 4, True, True)],
        "key string, value string, ts int, committed boolean, deleted boolean",
    )
    at = lambda t: sorted((r.key, r.value) for r in mvcc.read_at(v, ["key"], "ts", t, "committed", "deleted").collect())
    assert at(3) == [("a", "1"), ("b", "1")] and at(10) == [("a", "2")] and at(0) == []
    assert mvcc.collect_garbage(v, ["key"], "ts", "committed", 0).count() == 2 and mvcc.collect_garbage(v, ["key"], "ts", "committed", 1).count() == 5
    a = spark.createDataFrame([(1, "x", "write", 5), (2, "x", "write", 6), (2, "y", "read", 1), (1, "y", "write", 3), (1, "z", "read", 2), (2, "z", "write", 4), (3, "z", "write", 1)], "txn int, key string, kind string, ts int")
    assert sorted((r.conflict_type, r.key, r.other_txn) for r in mvcc.conflicts(a, 1).collect()) == [("ReadWrite", "y", 2), ("WriteRead", "z", 2), ("WriteWrite", "x", 2)]
    assert mvcc.would_conflict(a, 1, "y", True) and not mvcc.would_conflict(a, 1, "y", False)


def test_top():
    assert to_spark("SELECT TOP 3 a FROM t ORDER BY a") == "SELECT a FROM t ORDER BY a LIMIT 3"
    assert to_spark("SELECT DISTINCT TOP (2) a FROM t UNION SELECT top FROM u") == "SELECT DISTINCT a FROM t LIMIT 2 UNION SELECT top FROM u"
    assert to_spark("SELECT x FROM (SELECT TOP 1 x FROM (SELECT TOP 2 x FROM t)) WHERE x = 'TOP 3'") == "SELECT x FROM (SELECT x FROM (SELECT x FROM t LIMIT 2 ) LIMIT 1 ) WHERE x = 'TOP 3'"


def test_csv_with_line_breaks_comes_back(spark, tmp_path):
    rows = [(1, 'a\nb'), (2, '"q"\r\n, x'), (3, None), (4, "plain")]
    io.export_csv(spark.createDataFrame(rows, "id int, t string"), str(tmp_path / "c"))
    got = io.import_csv(spark, str(tmp_path / "c"), "id:INTEGER,t:TEXT", null_value="NULL").collect()
    assert sorted((r.id, (r.t or "").replace("\r\n", "\n")) for r in got) == [(i, (t or "").replace("\r\n", "\n")) for i, t in rows]


def test_shards_of_any_key(spark):
    import datetime

    from pyspark.sql import functions as F

    from lakemill.operators.sharding import hash_shard

    df = spark.createDataFrame([(-1, "a", 1.5, datetime.date(2024, 1, 1)), (7, "b", 2.5, None), (None, None, None, None)], "i int, s string, d double, t date")
    got = df.select(*(hash_shard(F.col(c), 4).alias(c) for c in df.columns)).collect()
    assert [r.i for r in got] == [3, 3, 0] and all(0 <= v < 4 for r in got for v in r) and got[2].s == 0
