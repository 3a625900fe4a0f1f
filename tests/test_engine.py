import pytest
from pyspark.errors import AnalysisException

from lakemill import ConstraintViolation, Engine, EngineError, ParseError, WriteConflict
from lakemill.errors import CatalogError, TransactionError
from lakemill.plans.cache import ResultCache

USERS = "CREATE TABLE users (id INTEGER, name VARCHAR(255), age INTEGER)"
THREE = "INSERT INTO users VALUES (1, 'Alice', 30), (2, 'Bob', 25), (3, 'Charlie', 35)"


def rows(result):
    return sorted(result.rows(), key=str)


def test_create_and_drop(engine):
    assert engine.execute(USERS).affected_rows == 1
    assert engine.tables() == ["users"]
    assert engine.execute("CREATE TABLE IF NOT EXISTS users (id INTEGER)").affected_rows == 0
    with pytest.raises(CatalogError):
        engine.execute("CREATE TABLE users (id INTEGER)")
    assert engine.execute("DROP TABLE users").affected_rows == 1
    assert engine.execute("DROP TABLE IF EXISTS users").affected_rows == 0
    with pytest.raises(CatalogError):
        engine.execute("DROP TABLE users")


def test_insert_and_select(engine):
    engine.execute(USERS)
    assert engine.execute("INSERT INTO users VALUES (1, 'Alice', 30)").affected_rows == 1
    assert engine.execute("INSERT INTO users VALUES (2, 'Bob', 25), (3, 'Charlie', 35)").affected_rows == 2
    found = engine.execute("SELECT * FROM users")
    assert found.columns == ["id", "name", "age"] and found.affected_rows == 3
    assert rows(engine.execute("SELECT name FROM users WHERE age > 28")) == [("Alice",), ("Charlie",)]


def test_update(engine):
    engine.script(f"{USERS}; {THREE}")
    assert engine.execute("UPDATE users SET age = age + 1 WHERE id = 1").affected_rows == 1
    assert engine.execute("UPDATE users SET age = 0 WHERE NULL").affected_rows == 0
    assert engine.execute("UPDATE users SET name = 'Unknown'").affected_rows == 3
    assert rows(engine.execute("SELECT * FROM users")) == [(1, "Unknown", 31), (2, "Unknown", 25), (3, "Unknown", 35)]


def test_update_writes_only_files_that_it_touches(engine):
    engine.execute(USERS)
    for i in range(3):
        engine.execute(f"INSERT INTO users VALUES ({i}, 'x', {i})")
    before = set(engine.schema("users").files)
    engine.execute("UPDATE users SET age = 9 WHERE id = 1")
    assert len(before & set(engine.schema("users").files)) == 2


def test_delete(engine):
    engine.script(f"{USERS}; {THREE}")
    assert engine.execute("DELETE FROM users WHERE age < 30").affected_rows == 1
    assert rows(engine.execute("SELECT name FROM users")) == [("Alice",), ("Charlie",)]
    assert engine.execute("DELETE FROM users").affected_rows == 2
    assert engine.execute("SELECT COUNT(*) FROM users").rows() == [(0,)]


def test_insert_errors(engine):
    engine.execute(USERS)
    for bad in ("INSERT INTO users VALUES (1, 'a')", "INSERT INTO users (id, name) VALUES (1)", "INSERT INTO users VALUES (1, 'a', 2) trailing"):
        with pytest.raises(ParseError):
            engine.execute(bad)
    with pytest.raises(CatalogError):
        engine.execute("INSERT INTO nobody VALUES (1)")
    with pytest.raises(CatalogError):
        engine.execute("INSERT INTO users (nothing) VALUES (1)")


def test_more_rows_than_a_thousand(engine):
    engine.execute("CREATE TABLE big (id BIGINT AUTO_INCREMENT, v BIGINT)")
    engine.execute("INSERT INTO big (v) SELECT id FROM range(2500)")
    engine.execute("INSERT INTO big (v) SELECT id FROM range(500)")
    assert engine.execute("SELECT COUNT(*), COUNT(DISTINCT id), MIN(id), MAX(id) FROM big").rows() == [(3000, 3000, 1, 3000)]


def test_alter(engine):
    engine.script(f"{USERS}; {THREE}")
    engine.execute("ALTER TABLE users ADD COLUMN email VARCHAR(255)")
    engine.execute("ALTER TABLE users ADD COLUMN points INTEGER NOT NULL DEFAULT 7")
    engine.execute("INSERT INTO users (id, points) VALUES (4, 1)")
    assert rows(engine.execute("SELECT id, email, points FROM users")) == [(1, None, 7), (2, None, 7), (3, None, 7), (4, None, 1)]
    engine.execute("ALTER TABLE users RENAME COLUMN name TO label")
    engine.execute("ALTER TABLE users DROP COLUMN age")
    engine.execute("ALTER TABLE users ALTER COLUMN points SET DEFAULT 3")
    engine.execute("INSERT INTO users (id) VALUES (5)")
    assert engine.execute("SELECT label, points FROM users WHERE id IN (1, 5) ORDER BY id").rows() == [("Alice", 7), (None, 3)]
    with pytest.raises(CatalogError):
        engine.execute("ALTER TABLE users ADD COLUMN must INTEGER NOT NULL")
    with pytest.raises(ConstraintViolation):
        engine.execute("ALTER TABLE users ALTER COLUMN label SET NOT NULL")
    engine.execute("ALTER TABLE users RENAME TO people")
    assert engine.tables() == ["people"]


def test_constraints(engine):
    engine.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, age INTEGER, CONSTRAINT adult CHECK (age >= 18), CONSTRAINT UNIQUE (name))")
    engine.execute("INSERT INTO t VALUES (1, 'a', 20), (2, 'b', NULL)")
    for bad in ("(1, 'c', 20)", "(3, 'a', 20)", "(3, 'c', 3)", "(3, NULL, 20)", "(NULL, 'c', 20)", "(4, 'd', 20), (4, 'e', 20)"):
        with pytest.raises(ConstraintViolation):
            engine.execute(f"INSERT INTO t VALUES {bad}")
    with pytest.raises(ConstraintViolation):
        engine.execute("UPDATE t SET id = 1")
    assert engine.execute("SELECT COUNT(*) FROM t").rows() == [(2,)]
    engine.execute("ALTER TABLE t DROP CONSTRAINT adult")
    engine.execute("INSERT INTO t VALUES (3, 'c', 3)")


def test_foreign_keys(engine):
    engine.execute("CREATE TABLE p (id INTEGER PRIMARY KEY)")
    engine.execute("CREATE TABLE c (id INTEGER, p INTEGER REFERENCES p (id))")
    engine.execute("CREATE TABLE n (id INTEGER, p INTEGER, CONSTRAINT FOREIGN KEY (p) REFERENCES p (id) ON DELETE SET NULL)")
    engine.execute("INSERT INTO p VALUES (1), (2), (3)")
    engine.execute("INSERT INTO c VALUES (1, 1), (2, NULL)")
    engine.execute("INSERT INTO n VALUES (1, 2)")
    with pytest.raises(ConstraintViolation):
        engine.execute("INSERT INTO c VALUES (3, 9)")
    with pytest.raises(ConstraintViolation):
        engine.execute("DELETE FROM p WHERE id = 1")
    assert engine.execute("DELETE FROM p WHERE id = 2").affected_rows == 1
    assert engine.execute("SELECT * FROM n").rows() == [(1, None)]
    with pytest.raises(CatalogError):
        engine.execute("DROP TABLE p")
    engine.execute("DROP TABLE p CASCADE")


def test_upsert_and_returning(engine):
    engine.execute("CREATE TABLE kv (k INTEGER PRIMARY KEY, v INTEGER)")
    engine.execute("INSERT INTO kv VALUES (1, 10), (2, 20)")
    got = engine.execute("INSERT INTO kv VALUES (2, 5), (3, 30) ON CONFLICT (k) DO UPDATE SET v = v + EXCLUDED.v RETURNING k, v")
    assert got.changed == 2 and rows(got) == [(2, 25), (3, 30)]
    assert engine.execute("INSERT INTO kv VALUES (2, 5), (4, 40) ON CONFLICT (k) DO NOTHING").affected_rows == 1
    assert rows(engine.execute("SELECT * FROM kv")) == [(1, 10), (2, 25), (3, 30), (4, 40)]
    assert rows(engine.execute("UPDATE kv SET v = 0 WHERE k > 2 RETURNING k, v")) == [(3, 0), (4, 0)]
    assert rows(engine.execute("DELETE FROM kv WHERE k = 1 RETURNING *")) == [(1, 10)]
    assert rows(engine.execute("INSERT INTO kv VALUES (9, 9) RETURNING k + 1 AS next")) == [(10,)]


def test_transactions(engine):
    engine.script(f"{USERS}; {THREE}")
    engine.script("BEGIN; DELETE FROM users; ROLLBACK")
    assert engine.execute("SELECT COUNT(*) FROM users").rows() == [(3,)]
    engine.execute("BEGIN TRANSACTION ISOLATION LEVEL SERIALIZABLE")
    engine.execute("DELETE FROM users WHERE id = 1")
    assert engine.execute("SELECT COUNT(*) FROM users").rows() == [(2,)]
    other = Engine(engine.spark, engine.warehouse)
    assert other.execute("SELECT COUNT(*) FROM users").rows() == [(3,)]
    engine.execute("COMMIT")
    assert other.execute("SELECT COUNT(*) FROM users").rows() == [(2,)]
    for bad in ("COMMIT", "ROLLBACK"):
        with pytest.raises(TransactionError):
            engine.execute(bad)


def test_write_conflict(engine):
    engine.script(f"{USERS}; CREATE TABLE other (id INTEGER); {THREE}")
    second = Engine(engine.spark, engine.warehouse)
    second.begin()
    second.execute("UPDATE users SET age = 1")
    engine.execute("INSERT INTO other VALUES (1)")
    second.commit()  # another table: no conflict
    second.begin()
    second.execute("UPDATE users SET age = 2")
    engine.execute("UPDATE users SET age = 3")
    with pytest.raises(WriteConflict):
        second.commit()
    assert engine.execute("SELECT DISTINCT age FROM users").rows() == [(3,)]


def test_versions(engine):
    engine.script(f"{USERS}; {THREE}")
    version = engine.pin()
    engine.execute("DELETE FROM users")
    assert engine.read_at("users", version).count() == 3
    assert engine.collect_garbage() > 0
    assert engine.read_at("users", version).count() == 3
    engine.unpin(version)
    engine.collect_garbage()
    assert engine.catalog.versions() == [engine.state.version]


def test_indexes(engine):
    engine.script(f"{USERS}; {THREE}")
    assert engine.execute("CREATE INDEX by_age ON users (age)").affected_rows == 1
    assert engine.execute("CREATE INDEX IF NOT EXISTS by_age ON users (age)").affected_rows == 0
    engine.execute("CREATE INDEX by_name ON users USING HASH (name)")
    assert [r.name for r in engine.index("by_age").range(25, 30).collect()] == ["Bob", "Alice"]
    assert [r.id for r in engine.index("by_name").get("Bob").collect()] == [2]
    with pytest.raises(EngineError):
        engine.index("by_name").range("a", "b")
    assert engine.execute("DROP INDEX by_age").affected_rows == 1
    with pytest.raises(CatalogError):
        engine.execute("DROP INDEX by_age")
    engine.execute("CREATE UNIQUE INDEX one_name ON users (name)")
    with pytest.raises(ConstraintViolation):
        engine.execute("INSERT INTO users VALUES (9, 'Bob', 1)")


def test_unique_index_on_double_rows(engine):
    engine.script("CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (1), (1)")
    with pytest.raises(ConstraintViolation):
        engine.execute("CREATE UNIQUE INDEX u ON t (a)")


def test_prepared(engine):
    engine.script(f"{USERS}; {THREE}")
    engine.execute("PREPARE q AS SELECT name FROM users WHERE id = $1 OR age = $2 OR id = $1")
    assert rows(engine.execute("EXECUTE q(1, 25)")) == [("Alice",), ("Bob",)]
    engine.execute("PREPARE w AS UPDATE users SET name = $1 WHERE id = $2")
    assert engine.execute_prepared("w", ["O'Neil \\ x", 1]).affected_rows == 1
    assert engine.execute("SELECT name FROM users WHERE id = 1").rows() == [("O'Neil \\ x",)]
    with pytest.raises(EngineError):
        engine.execute("EXECUTE q(1)")
    engine.execute("DEALLOCATE q")
    with pytest.raises(EngineError):
        engine.execute("EXECUTE q(1, 2)")


def test_result_cache(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"), cache=ResultCache(max_entries=2))
    e.script(f"{USERS}; {THREE}")
    for sql in ("SELECT COUNT(*) FROM users", "select count(*)   from users"):
        assert e.execute(sql).rows() == [(3,)]
    assert (e.cache.hits, e.cache.misses, e.cache.hit_rate) == (1, 1, 0.5)
    e.execute("DELETE FROM users WHERE id = 1")
    assert e.execute("SELECT COUNT(*) FROM users").rows() == [(2,)]
    e.execute("SELECT 1")
    assert len(e.cache) == 2 and e.cache.evictions == 1


def test_select_errors_are_sparks(engine):
    engine.execute(USERS)
    with pytest.raises(AnalysisException):
        engine.execute("SELECT missing FROM users")
    with pytest.raises(AnalysisException):
        engine.execute("SELECT name, COUNT(*) FROM users")


def test_quoted_names_and_types(engine):
    engine.execute('CREATE TABLE "Odd Name" ("a b" DOUBLE PRECISION, d DECIMAL(10,2), t TIMESTAMP, b BLOB, j JSON, u UUID, f BOOLEAN)')
    engine.execute("""INSERT INTO "Odd Name" VALUES (1.5, 2.25, TIMESTAMP_NTZ'2024-01-01 00:00:00', X'0102', '{}', 'x', TRUE)""")
    assert engine.execute('SELECT "a b", d, f FROM "Odd Name"').affected_rows == 1


def test_streamed_batches_commit_once(engine):
    engine.execute("CREATE TABLE s (a INTEGER)")
    df = engine.spark.createDataFrame([(1,)], "a int")
    assert engine.append("s", df, ("stream", 0)) == 1
    assert engine.append("s", df, ("stream", 0)) == 0
    assert engine.append("s", df, ("stream", 1)) == 1
    assert engine.execute("SELECT COUNT(*) FROM s").rows() == [(2,)]


def test_optimize_sorts_files(engine):
    engine.execute("CREATE TABLE o (k BIGINT)")
    engine.execute("INSERT INTO o SELECT id FROM range(1000)")
    assert engine.optimize("o", ["k"]) == 1000
    assert engine.execute("SELECT COUNT(*), SUM(k) FROM o").rows() == [(1000, 499500)]


def test_update_from(engine):
    engine.script(f"{USERS}; {THREE}; CREATE TABLE extra (id INTEGER, add_age INTEGER); INSERT INTO extra VALUES (1, 5), (3, 7), (9, 1)")
    got = engine.execute("UPDATE users SET age = users.age + e.add_age FROM extra e WHERE e.id = users.id AND e.add_age > 5 RETURNING id, age")
    assert got.changed == 1 and rows(got) == [(3, 42)]
    assert engine.execute("UPDATE users u SET age = 0 FROM extra e WHERE e.id = u.id AND e.add_age > 100").affected_rows == 0
    engine.execute("INSERT INTO extra VALUES (1, 6)")
    with pytest.raises(ParseError):
        engine.execute("UPDATE users SET age = add_age FROM extra WHERE extra.id = users.id")
    assert engine.execute("UPDATE users AS u SET age = u.age + 1 WHERE u.id = 2").affected_rows == 1
    assert rows(engine.execute("SELECT id, age FROM users")) == [(1, 30), (2, 26), (3, 42)]


def test_truncate_and_vacuum(engine):
    engine.script(f"{USERS}; {THREE}; CREATE TABLE ref (id INTEGER); DELETE FROM users WHERE id = 1; TRUNCATE users")
    assert engine.execute("SELECT COUNT(*) FROM users").rows() == [(0,)]
    engine.execute("INSERT INTO users VALUES (4, 'Dan', 1)")
    assert engine.execute("VACUUM").affected_rows > 0 and len(engine.catalog.versions()) == 1
    engine.catalog.sweep(-1.0)  # the folders that the files which went have left
    engine.catalog.files.write(f"{engine.warehouse}/data/users/lost/part-0.parquet", "x")
    assert engine.catalog.sweep(3600.0) == 0 and engine.catalog.sweep(-1.0) == 1
    assert rows(engine.execute("SELECT id FROM users")) == [(4,)]
    engine.execute("CREATE TABLE p (id INTEGER PRIMARY KEY)")
    engine.script("CREATE TABLE c (p INTEGER REFERENCES p (id)); INSERT INTO p VALUES (1); INSERT INTO c VALUES (1)")
    with pytest.raises(ConstraintViolation):
        engine.execute("TRUNCATE TABLE p")


def test_views(engine):
    engine.script(f"{USERS}; {THREE}; CREATE VIEW old (who) AS SELECT name FROM users WHERE age >= 30; CREATE VIEW older AS SELECT upper(who) AS w FROM old")
    assert rows(engine.execute("SELECT w FROM older")) == [("ALICE",), ("CHARLIE",)] and engine.views() == ["old", "older"]
    engine.execute("UPDATE users SET age = 99 WHERE id = 2")
    assert engine.execute("SELECT COUNT(*) FROM older").rows() == [(3,)]
    for bad in ("INSERT INTO old VALUES ('x')", "UPDATE old SET who = 'x'", "DELETE FROM old", "TRUNCATE old", "DROP TABLE old", "CREATE VIEW old AS SELECT 1 AS a", "CREATE OR REPLACE VIEW old AS SELECT w AS who FROM older", "REFRESH MATERIALIZED VIEW old", "DROP VIEW users", "ALTER TABLE old ADD COLUMN x INTEGER"):
        with pytest.raises(CatalogError):
            engine.execute(bad)
    engine.execute("CREATE OR REPLACE VIEW old (who) AS SELECT name FROM users WHERE id = 1")
    assert rows(engine.execute("SELECT w FROM older")) == [("ALICE",)]
    engine.execute("CREATE MATERIALIZED VIEW held AS SELECT id FROM users")
    engine.execute("DELETE FROM users WHERE id = 1")
    assert engine.execute("SELECT COUNT(*) FROM held").rows() == [(3,)]
    assert engine.execute("REFRESH MATERIALIZED VIEW held").affected_rows == 2
    engine.script("DROP MATERIALIZED VIEW held; DROP VIEW older; DROP VIEW IF EXISTS older; DROP VIEW old")
    assert engine.views() == [] and engine.tables() == ["users"]


def test_cache_sees_the_tables_of_views(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "t"), cache=ResultCache())
    e.script(f"{USERS}; {THREE}; CREATE VIEW v AS SELECT id FROM users")
    assert e.execute("SELECT COUNT(*) FROM v").rows() == [(3,)]
    e.execute("DELETE FROM users WHERE id = 1")
    assert e.execute("SELECT COUNT(*) FROM v").rows() == [(2,)]
    e.attach("x", spark.range(3).toDF("k"))
    assert e.execute("SELECT COUNT(*) FROM x").rows() == [(3,)]
    e.attach("x", spark.range(4).toDF("k"))
    assert e.execute("SELECT COUNT(*) FROM x").rows() == [(4,)]


def test_referential_actions_are_checked_and_touch_few_files(engine):
    engine.execute("CREATE TABLE p (id INTEGER PRIMARY KEY)")
    engine.execute("CREATE TABLE must (id INTEGER, p INTEGER NOT NULL REFERENCES p (id) ON DELETE SET NULL)")
    engine.execute("CREATE TABLE may (id INTEGER, p INTEGER DEFAULT 3 REFERENCES p (id) ON DELETE SET DEFAULT)")
    engine.execute("INSERT INTO p VALUES (1), (2), (3)")
    engine.execute("INSERT INTO must VALUES (1, 1)")
    for i in (2, 3):
        engine.execute(f"INSERT INTO may VALUES ({i}, {i})")
    with pytest.raises(ConstraintViolation):
        engine.execute("DELETE FROM p WHERE id = 1")
    before = set(engine.schema("may").files)
    engine.execute("DELETE FROM p WHERE id = 2")
    assert rows(engine.execute("SELECT * FROM may")) == [(2, 3), (3, 3)] and len(before & set(engine.schema("may").files)) == 1
    with pytest.raises(ConstraintViolation):  # the default itself goes
        engine.execute("DELETE FROM p WHERE id = 3")


def test_renamed_columns_keep_their_constraints(engine):
    engine.execute("CREATE TABLE p (id INTEGER PRIMARY KEY, age INTEGER, CHECK (age > 0))")
    engine.execute("CREATE TABLE c (p INTEGER REFERENCES p (id))")
    engine.script("INSERT INTO p VALUES (1, 5); INSERT INTO c VALUES (1); ALTER TABLE p RENAME COLUMN age TO years; ALTER TABLE p RENAME COLUMN id TO key; ALTER TABLE p RENAME TO people")
    for bad in ("INSERT INTO people VALUES (2, 0)", "INSERT INTO people VALUES (1, 1)", "DELETE FROM people", "INSERT INTO c VALUES (9)"):
        with pytest.raises(ConstraintViolation):
            engine.execute(bad)


def test_checks_of_what_an_alter_adds(engine):
    engine.script("CREATE TABLE t (a INTEGER, b VARCHAR(3)); INSERT INTO t VALUES (1, 'x'), (1, 'y')")
    for bad in ("ALTER TABLE t ADD CONSTRAINT UNIQUE (a)", "ALTER TABLE t ADD CONSTRAINT c CHECK (a > 1)", "ALTER TABLE t ADD COLUMN d VARCHAR(2) DEFAULT 'long'"):
        with pytest.raises(ConstraintViolation):
            engine.execute(bad)
    engine.script("ALTER TABLE t ADD CONSTRAINT UNIQUE (b); ALTER TABLE t ALTER COLUMN a SET NOT NULL")
    with pytest.raises(ConstraintViolation):
        engine.execute("UPDATE t SET b = 'x'")


def test_serial_top_and_ranges(engine):
    engine.execute("CREATE TABLE s (id BIGSERIAL PRIMARY KEY, day DATE, v INTEGER) PARTITION BY RANGE (day)")
    engine.execute("INSERT INTO s (day, v) VALUES (DATE'2024-01-01', 1), (DATE'2024-02-01', 2)")
    engine.execute("INSERT INTO s (day, v) VALUES (DATE'2024-03-01', 3)")
    assert engine.execute("SELECT TOP 2 id, v FROM s ORDER BY id DESC").rows() == [(3, 3), (2, 2)]
    assert engine.execute("(SELECT TOP 1 v FROM s ORDER BY v) UNION ALL SELECT 9 AS v").affected_rows == 2
    with pytest.raises(CatalogError):
        engine.execute("ALTER TABLE s DROP COLUMN day")
    engine.execute("CREATE TABLE r (k INTEGER, t TEXT) PARTITION BY RANGE (k) (PARTITION a VALUES LESS THAN (10), PARTITION b VALUES LESS THAN MAXVALUE)")
    engine.execute("INSERT INTO r VALUES (1, 'x'), (10, 'y'), (NULL, 'z')")
    engine.execute("UPDATE r SET k = 20 WHERE k = 1")
    assert rows(engine.execute("SELECT * FROM r")) == [(10, "y"), (20, "x"), (None, "z")]


def test_options_of_a_query(engine):
    engine.attach("big", engine.spark.range(10))
    assert len(engine.fetch("SELECT * FROM big", max_rows=4)) == 4
    with pytest.raises(EngineError, match="more than"):
        engine.fetch("SELECT COUNT_IF((a.id + b.id) % 7 = 3) FROM range(300000) a CROSS JOIN range(20000) b", timeout=1.0)
    assert len(engine.profile("SELECT * FROM big", 2)) == 2


def test_open_transactions_end(spark, tmp_path):
    now = [0.0]
    e = Engine(spark, str(tmp_path / "t"), transaction_seconds=5, clock=lambda: now[0])
    e.execute("CREATE TABLE t (a INTEGER)")
    e.execute("BEGIN")
    now[0] = 4.0
    e.execute("INSERT INTO t VALUES (1)")
    assert not e.cleanup()
    now[0] = 6.0
    with pytest.raises(TransactionError):
        e.execute("SELECT * FROM t")
    e.script("BEGIN; INSERT INTO t VALUES (2)")
    now[0] = 20.0
    assert e.cleanup() and not e.in_transaction
    assert e.execute("SELECT COUNT(*) FROM t").rows() == [(0,)]


def test_staged_tables_go(engine, tmp_path):
    engine.execute("CREATE TABLE kv (k INTEGER PRIMARY KEY, v SERIAL)")
    engine.execute("INSERT INTO kv (k) VALUES (1), (2)")
    engine.execute("INSERT INTO kv (k) VALUES (2), (3) ON CONFLICT (k) DO NOTHING")
    assert engine.catalog.files.names(f"{engine.warehouse}/staged") == []
