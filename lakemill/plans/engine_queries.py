"""Queries that run through the engine: DDL, DML, transactions, indexes, versions, import and export, statistics.

Each makes its tables from the test tables by statements and returns what a reader then sees; the SQL beside it
computes the same from the test tables directly.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.errors import ConstraintViolation, EngineError, TransactionError, WriteConflict
from lakemill.functions import mvcc
from lakemill.functions.statistics import Statistics, column_stats, histogram
from lakemill.operators.index import key_range
from lakemill.operators.sharding import hash_shard, range_shard
from lakemill.plans.cache import ResultCache
from lakemill.session import Engine
from lakemill.sources import files as io

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
NATION = "CREATE TABLE nation_t (n_nationkey INTEGER PRIMARY KEY, n_name VARCHAR(255), n_regionkey INTEGER)"


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise EngineError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lakemill-")
    return f"{base.rstrip('/')}/lakemill/{uuid.uuid4().hex}"


def engine(spark: SparkSession, sf_dir: str, *tables: str, **options) -> Engine:
    e = Engine(spark, folder(spark), **options)
    for t in tables:
        e.attach(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return e


def nations(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, sf_dir, "nation")
    e.execute(NATION)
    e.execute("INSERT INTO nation_t SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return e


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, oracle)
        return f

    return add


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("UPDATE nation_t SET n_name = 'X' WHERE n_regionkey = 1")
    return e.table("nation_t")


@query("SELECT n_nationkey, n_name || '!' AS n_name, n_regionkey + 1 AS n_regionkey FROM nation")
def dml_update_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("UPDATE nation_t SET n_regionkey = n_regionkey + 1, n_name = n_name || '!'")
    return e.table("nation_t")


@query("SELECT * FROM nation WHERE NOT COALESCE(n_regionkey = 1, FALSE)")
def dml_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("DELETE FROM nation_t WHERE n_regionkey = 1")
    return e.table("nation_t")


@query("SELECT * FROM nation WHERE FALSE")
def dml_delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("DELETE FROM nation_t")
    return e.table("nation_t")


@query("SELECT * FROM (VALUES (1, 'Alice', 30), (2, 'Bob', NULL), (3, 'It''s', -5)) t(id, name, age)")
def dml_insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("CREATE TABLE users (id INTEGER, name TEXT, age INTEGER)")
    e.execute("INSERT INTO users VALUES (1, 'Alice', 30)")
    e.execute(r"INSERT INTO users VALUES (2, 'Bob', NULL), (3, 'It\'s', -5)")
    return e.table("users")


@query("SELECT * FROM (VALUES (1, 'Alice', 18), (2, NULL, 25)) t(id, name, age)")
def dml_insert_column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("CREATE TABLE users (id INTEGER NOT NULL, name VARCHAR(255), age INTEGER DEFAULT 18)")
    e.execute("INSERT INTO users (name, id) VALUES ('Alice', 1)")
    e.execute("INSERT INTO users (age, id) VALUES (25, 2)")
    return e.table("users")


@query("SELECT * FROM (VALUES (1, 18, 'a'), (2, 18, 'b'), (3, 7, 'c')) t(id, age, name)")
def dml_insert_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute("CREATE TABLE users (id INTEGER AUTO INCREMENT, age INTEGER DEFAULT 18, name TEXT)")
    e.execute("INSERT INTO users (age, name) VALUES (DEFAULT, 'a')")
    e.execute("INSERT INTO users (name) VALUES ('b')")
    e.execute("INSERT INTO users (name, age) VALUES ('c', 7)")
    return e.table("users")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def dml_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    e.execute("CREATE TABLE finished (o_orderkey BIGINT, o_totalprice DOUBLE)")
    e.execute("INSERT INTO finished SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
    return e.table("finished")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def dml_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).execute("DELETE FROM nation_t WHERE n_regionkey = 2 RETURNING n_nationkey, n_name").df


@query("SELECT COALESCE(u.k, n.n_nationkey) AS n_nationkey, COALESCE(u.nm, n.n_name) AS n_name FROM nation n FULL OUTER JOIN (SELECT 3 AS k, 'NEW' AS nm UNION ALL SELECT 99, 'ADDED') u ON n.n_nationkey = u.k")
def wc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("INSERT INTO nation_t (n_nationkey, n_name) VALUES (3, 'NEW'), (99, 'ADDED') ON CONFLICT (n_nationkey) DO UPDATE SET n_name = EXCLUDED.n_name")
    return e.execute("SELECT n_nationkey, n_name FROM nation_t").df


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 99, 'ADDED'")
def upsert_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("INSERT INTO nation_t (n_nationkey, n_name) VALUES (3, 'NEW'), (99, 'ADDED') ON CONFLICT (n_nationkey) DO NOTHING")
    return e.execute("SELECT n_nationkey, n_name FROM nation_t").df


@query("SELECT r.*, CAST(NULL AS VARCHAR) AS note FROM region r")
def ddl_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "region")
    e.execute("CREATE TABLE region_t (r_regionkey INTEGER, r_name TEXT)")
    e.execute("INSERT INTO region_t SELECT r_regionkey, r_name FROM region")
    e.execute("ALTER TABLE region_t ADD COLUMN note VARCHAR(255)")
    return e.table("region_t")


@query("SELECT r_regionkey, 'none' AS note, r_name AS label FROM region UNION ALL SELECT 9, 'some', 'NINE'")
def ddl_alter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "region")
    e.execute("CREATE TABLE region_t (r_regionkey INTEGER, gone TEXT, r_name TEXT)")
    e.execute("INSERT INTO region_t SELECT r_regionkey, r_name, r_name FROM region")
    e.script("ALTER TABLE region_t ADD COLUMN note TEXT DEFAULT 'none'; ALTER TABLE region_t DROP COLUMN gone; ALTER TABLE region_t RENAME COLUMN r_name TO label")
    e.execute("INSERT INTO region_t (r_regionkey, note, label) VALUES (9, 'some', 'NINE')")
    return e.execute("SELECT r_regionkey, note, label FROM region_t").df


@query("SELECT CAST(NULL AS INTEGER) AS id WHERE FALSE")
def ddl_drop_recreate_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.script("CREATE TABLE users (id INTEGER); INSERT INTO users VALUES (1), (2); DROP TABLE users; CREATE TABLE users (id INTEGER);")
    return e.table("users")


@query("SELECT * FROM (VALUES (1, 0, 0, 1)) t(created, again, dropped_missing, dropped)")
def ddl_affected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    statements = ["CREATE TABLE IF NOT EXISTS t (id INTEGER)", "CREATE TABLE IF NOT EXISTS t (id INTEGER)", "DROP TABLE IF EXISTS other", "DROP TABLE t"]
    return spark.createDataFrame([tuple(e.execute(s).affected_rows for s in statements)], "created int, again int, dropped_missing int, dropped int")


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def index_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed_orders(spark, sf_dir, "BTREE").index("by_key").get(42)


def _indexed_orders(spark: SparkSession, sf_dir: str, method: str) -> Engine:
    e = engine(spark, sf_dir, "orders")
    e.execute("CREATE TABLE orders_t (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus TEXT, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority TEXT)")
    e.execute("INSERT INTO orders_t SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
    e.execute(f"CREATE UNIQUE INDEX by_key ON orders_t USING {method} (o_orderkey)")
    e.optimize("orders_t", ["o_orderkey"])
    return e


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 200")
def index_range_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed_orders(spark, sf_dir, "BTREE").index("by_key").range(100, 200).select("o_orderkey")


@query("SELECT TRUE AS rejected, COUNT(*) AS c FROM orders WHERE o_orderkey = 7")
def index_hash_range_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _indexed_orders(spark, sf_dir, "HASH").index("by_key")
    try:
        index.range(1, 2)
        rejected = False
    except EngineError:
        rejected = True
    return index.get(7).agg(F.lit(rejected).alias("rejected"), F.count("*").alias("c"))


@query("SELECT 'by_key' AS name, 'orders_t' AS \"table\", TRUE AS \"unique\", 'BTREE' AS method")
def index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed_orders(spark, sf_dir, "BTREE").execute("SHOW INDEXES").df.drop("columns")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def iter_range_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_range(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 100, 200).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 200 ORDER BY o_orderkey DESC LIMIT 7")
def iter_reverse_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_range(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 100, 200, include_start=False, include_end=True, reverse=True, limit=7).select("o_orderkey")


@query("SELECT user_id, event_id, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' AND event_type <> 'error') v WHERE rn = 1")
def mvcc_read_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value", (F.col("event_type") != "error").alias("committed"))
    at = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    return mvcc.read_at(events, ["user_id"], "ts", at, committed="committed", tie=["event_id"]).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) v WHERE rn = 1 AND event_type <> 'error'")
def mvcc_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("deleted"))
    return mvcc.read_at(events, ["user_id"], "ts", F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00")), deleted="deleted", tie=["event_id"]).select("user_id", "event_id")


@query("SELECT COUNT(DISTINCT user_id) AS keys, COUNT(*) AS versions, COUNT(DISTINCT CASE WHEN event_type = 'error' THEN event_id END) AS active_transactions FROM events")
def mvcc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("committed", F.col("event_type") != "error")
    return mvcc.version_stats(events, ["user_id"], "event_id", "committed")


@query("""
WITH a AS (SELECT user_id % 20 AS txn, event_id % 500 AS key, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS kind, MAX(event_id) AS ts FROM events GROUP BY 1, 2, 3)
SELECT CASE WHEN o.kind = 'write' AND p.kind = 'write' THEN 'WriteWrite' WHEN o.kind = 'write' AND p.kind = 'read' AND p.ts < o.ts THEN 'ReadWrite'
            WHEN o.kind = 'read' AND p.kind = 'write' AND p.ts > o.ts THEN 'WriteRead' END AS conflict_type, o.key, o.txn, p.txn AS other_txn, o.ts, p.ts AS other_ts
FROM a o JOIN a p ON o.key = p.key AND o.txn = 3 AND p.txn <> 3
WHERE (o.kind = 'write' AND p.kind = 'write') OR (o.kind = 'write' AND p.kind = 'read' AND p.ts < o.ts) OR (o.kind = 'read' AND p.kind = 'write' AND p.ts > o.ts)
""")
def txn_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    accesses = events.select((F.col("user_id") % 20).alias("txn"), (F.col("event_id") % 500).alias("key"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("kind"), F.col("event_id").alias("ts"))
    return mvcc.conflicts(accesses, 3)


@query("SELECT * FROM nation")
def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.script("BEGIN; DELETE FROM nation_t WHERE n_regionkey < 3; INSERT INTO nation_t VALUES (77, 'X', 1); ROLLBACK;")
    return e.table("nation_t")


@query("SELECT * FROM nation WHERE n_regionkey >= 3 UNION ALL SELECT 77, 'X', 1")
def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.script("BEGIN TRANSACTION; DELETE FROM nation_t WHERE n_regionkey < 3; INSERT INTO nation_t VALUES (77, 'X', 1); COMMIT;")
    return e.table("nation_t")


@query("SELECT *, TRUE AS second_failed FROM nation WHERE n_nationkey <> 1")
def txn_write_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    other = Engine(spark, e.warehouse)
    other.begin()
    e.execute("DELETE FROM nation_t WHERE n_nationkey = 1")
    other.execute("DELETE FROM nation_t WHERE n_nationkey = 2")
    try:
        other.commit()
        failed = False
    except WriteConflict:
        failed = True
    return e.table("nation_t").withColumn("second_failed", F.lit(failed))


@query("SELECT * FROM nation")
def mvcc_snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    version = e.pin()
    e.script("UPDATE nation_t SET n_name = 'gone'; DELETE FROM nation_t WHERE n_nationkey < 20")
    e.collect_garbage()
    return e.read_at("nation_t", version)


@query("SELECT n_nationkey, 'kept' AS n_name, n_regionkey FROM nation")
def mvcc_gc_keeps_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.script("UPDATE nation_t SET n_name = 'gone'; UPDATE nation_t SET n_name = 'kept'")
    e.collect_garbage()
    return e.table("nation_t")


@query("SELECT TRUE AS null_key, TRUE AS double_key, TRUE AS bad_check, TRUE AS no_parent, TRUE AS too_long, COUNT(*) AS c FROM nation")
def constraint_check_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("CREATE TABLE city (id INTEGER NOT NULL, nation INTEGER, people INTEGER, code VARCHAR(3), CONSTRAINT CHECK (people > 0), CONSTRAINT FOREIGN KEY (nation) REFERENCES nation_t (n_nationkey))")

    def rejected(sql: str) -> bool:
        try:
            e.execute(sql)
            return False
        except ConstraintViolation:
            return True

    found = {
        "null_key": rejected("INSERT INTO city VALUES (NULL, 1, 5, 'a')"),
        "double_key": rejected("INSERT INTO nation_t VALUES (3, 'again', 1)"),
        "bad_check": rejected("INSERT INTO city VALUES (1, 1, 0, 'a')"),
        "no_parent": rejected("INSERT INTO city VALUES (1, 12345, 5, 'a')"),
        "too_long": rejected("INSERT INTO city VALUES (1, 1, 5, 'abcd')"),
    }
    e.execute("INSERT INTO city VALUES (1, NULL, NULL, 'abc')")
    return e.table("nation_t").agg(*(F.lit(v).alias(k) for k, v in found.items()), F.count("*").alias("c"))


@query("SELECT n_nationkey AS id FROM nation WHERE n_regionkey <> 0")
def constraint_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("CREATE TABLE city (id INTEGER, nation INTEGER, FOREIGN KEY (nation) REFERENCES nation_t (n_nationkey) ON DELETE CASCADE)")
    e.execute("INSERT INTO city SELECT n_nationkey, n_nationkey FROM nation")
    e.execute("DELETE FROM nation_t WHERE n_regionkey = 0")
    return e.execute("SELECT id FROM city").df


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderkey = 42 OR o_orderkey = 7")
def prepared_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    e.execute("PREPARE mine AS SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = $1 OR o_orderkey = $2 OR o_orderkey = $1")
    return e.execute("EXECUTE mine(7, 42)").df


@query("SELECT 1 AS hits, 2 AS misses, COUNT(*) - 1 AS c FROM nation")
def cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation", cache=ResultCache())
    e.execute(NATION)
    e.execute("INSERT INTO nation_t SELECT n_nationkey, n_name, n_regionkey FROM nation")
    e.execute("SELECT COUNT(*) AS c FROM nation_t")
    e.execute("select count(*) as c  from nation_t -- again")
    e.execute("DELETE FROM nation_t WHERE n_nationkey = 0")
    after = e.execute("SELECT COUNT(*) AS c FROM nation_t").df
    return after.select(F.lit(e.cache.hits).alias("hits"), F.lit(e.cache.misses).alias("misses"), "c")


@query("SELECT COUNT(*) AS row_count, COUNT(DISTINCT o_orderstatus) AS distinct_count, COUNT(*) - COUNT(o_orderstatus) AS null_count, MIN(o_orderstatus) AS min_value, MAX(o_orderstatus) AS max_value FROM orders")
def stats_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_stats(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderstatus").toDF("row_count", "distinct_count", "null_count", "min_value", "max_value")


@query("SELECT LEAST(CAST(FLOOR(o_totalprice / 50000) AS INT), 9) AS bucket, COUNT(*) AS row_count FROM orders GROUP BY 1")
def stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", 50000, 10)


@query("SELECT 'region' AS table_name, 'r_name' AS column_name, COUNT(*) AS row_count, COUNT(DISTINCT r_name) AS distinct_count, 0::BIGINT AS null_count, MIN(r_name) AS min_value, MAX(r_name) AS max_value FROM region")
def stats_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "region")
    return e.execute("ANALYZE TABLE region").df.where("column_name = 'r_name'").select("table_name", "column_name", "row_count", "distinct_count", "null_count", "min_value", "max_value")


@query("""
SELECT step, cost FROM (SELECT COUNT(*) AS n FROM orders) o, LATERAL (VALUES
  ('aggregate', 0.01 * (2 * n + 3)), ('hash_join', 0.01 * (2 * n + 25)), ('index_scan', FLOOR(n * 0.1) * 4.0 + n * 0.01),
  ('nested_loop', n * 25 * 0.01), ('seq_scan', FLOOR(n * 50 / 8192.0) + n * 0.01)) v(step, cost)
""".replace("cost FROM", "ROUND(CAST(cost AS DOUBLE), 6) AS cost FROM"))
def cost_model_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    costs = {"seq_scan": Statistics.seq_scan(n, 50), "index_scan": Statistics.index_scan(0.1, n), "hash_join": Statistics.hash_join(n, 25), "nested_loop": Statistics.nested_loop(n, 25), "aggregate": Statistics.aggregate(n, 3)}
    return spark.createDataFrame([(k, round(v, 6)) for k, v in costs.items()], "step string, cost double")


@query("SELECT 1.0::DOUBLE / COUNT(DISTINCT o_orderstatus) AS eq, 1 - 1.0::DOUBLE / COUNT(DISTINCT o_orderstatus) AS ne, 0.33::DOUBLE AS lt, 0.5::DOUBLE AS other, CAST(FLOOR(COUNT(*) * 0.33::DOUBLE) AS BIGINT) AS rows FROM orders")
def selectivity_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Statistics.collect({"orders": spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")})
    at = lambda op: s.selectivity("orders", "o_orderstatus", op)
    return spark.createDataFrame([(at("="), at("!="), at("<"), at("LIKE"), s.rows("orders", at("<")))], "eq double, ne double, lt double, other double, rows long")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/nation.csv"
    io.export_csv(spark.read.parquet(f"{sf_dir}/nation.parquet"), path, delimiter=";")
    return io.import_csv(spark, path, "n_nationkey:INTEGER,n_name:VARCHAR,n_regionkey:INTEGER", delimiter=";")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def import_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/nation.json"
    io.export_json_array(spark.read.parquet(f"{sf_dir}/nation.parquet"), path, pretty=True)
    return io.import_json(spark, path, "n_nationkey:INTEGER,n_name:TEXT,n_regionkey:INTEGER")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ', \"quoted\"' END AS p_name, p_retailprice FROM part")
def export_roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(', "quoted"'))).alias("p_name"), "p_retailprice")
    path = folder(spark) + "/part.csv"
    io.export_csv(part, path)
    return io.import_csv(spark, path, "p_partkey:BIGINT,p_name:TEXT,p_retailprice:DOUBLE", null_value="NULL")


@query("SELECT p_partkey, NULLIF(p_brand, 'Brand#2') AS p_brand, p_retailprice FROM part")
def export_roundtrip_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#2")).alias("p_brand"), "p_retailprice")
    path = folder(spark) + "/part.json"
    io.export_ndjson(part, path)
    return io.import_json(spark, path, "p_partkey:BIGINT,p_brand:TEXT,p_retailprice:DOUBLE", lines=True)


@query("SELECT c_custkey, CAST(c_custkey % 4 AS INT) AS shard FROM customer")
def shard_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", hash_shard(F.col("c_custkey"), 4).alias("shard"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 5000 THEN 0 WHEN o_orderkey < 10000 THEN 1 ELSE 2 END AS shard FROM orders")
def shard_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", range_shard(F.col("o_orderkey"), [5000, 10000]).alias("shard"))


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def script_quoted_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    e.script("""
        -- a script; with a comment
        CREATE TABLE "my nations" (n_name TEXT, "n regionkey" INTEGER);
        INSERT INTO "my nations" SELECT n_name, n_regionkey FROM nation /* all; of them */;
    """)
    return e.execute("""SELECT n_name, "n regionkey" AS n_regionkey FROM "my nations" WHERE "n regionkey" = 1""").df


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, CAST(n_name AS VARCHAR) AS n FROM nation")
def cast_text_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "nation").execute("SELECT CAST(n_nationkey AS TEXT) AS k, CAST(n_name AS VARCHAR) AS n FROM nation").df


@query("SELECT COUNT(*) AS c, CAST(SUM(value) AS DECIMAL(18,2)) AS s FROM (SELECT CAST(value AS DECIMAL(18,2)) AS value FROM events)")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.streaming.ingest import append_stream

    e = engine(spark, sf_dir)
    e.execute("CREATE TABLE events_t (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type TEXT, value DOUBLE, props TEXT)")
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet")
    append_stream(e, source, "events_t", "events", folder(spark) + "/checkpoint").awaitTermination()
    return e.execute("SELECT COUNT(*) AS c, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS s FROM events_t").df


def fails(kind: type[Exception], f: Callable, *arguments) -> bool:
    try:
        f(*arguments)
        return False
    except kind:
        return True


@query("SELECT n_nationkey, CASE WHEN r_regionkey < 2 THEN r_name || '/' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def dml_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.attach("region", spark.read.parquet(f"{sf_dir}/region.parquet"))
    e.execute("UPDATE nation_t AS n SET n_name = r.r_name || '/' || n.n_name FROM region r WHERE r.r_regionkey = n.n_regionkey AND r.r_regionkey < 2")
    return e.table("nation_t")


@query("SELECT 1 AS affected, COUNT(*) AS c, MIN(k) AS k FROM (SELECT 7 AS k)")
def ddl_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    affected = e.execute("TRUNCATE TABLE nation_t").affected_rows
    e.execute("INSERT INTO nation_t VALUES (7, 'after', 1)")
    return e.execute("SELECT COUNT(*) AS c, MIN(n_nationkey) AS k FROM nation_t").df.withColumn("affected", F.lit(affected))


@query("SELECT n_nationkey, 'second' AS n_name, n_regionkey, 1 AS versions FROM nation")
def ddl_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.script("UPDATE nation_t SET n_name = 'first'; UPDATE nation_t SET n_name = 'second'; VACUUM nation_t")
    return e.table("nation_t").withColumn("versions", F.lit(len(e.catalog.versions())))


@query("SELECT n_regionkey AS region, COUNT(*) AS c FROM nation WHERE n_nationkey <> 3 GROUP BY n_regionkey")
def view_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of a view shows what its table holds now."""
    e = nations(spark, sf_dir)
    e.script("CREATE VIEW pairs (nation, region) AS SELECT n_nationkey, n_regionkey FROM nation_t; CREATE VIEW counted AS SELECT region, COUNT(*) AS c FROM pairs GROUP BY region")
    e.execute("DELETE FROM nation_t WHERE n_nationkey = 3")
    return e.execute("SELECT region, c FROM counted").df


@query("SELECT COUNT(*) AS kept, COUNT(*) - 5 AS refreshed FROM nation")
def view_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("CREATE MATERIALIZED VIEW names AS SELECT n_name FROM nation_t")
    e.execute("DELETE FROM nation_t WHERE n_nationkey < 5")
    kept = e.execute("SELECT COUNT(*) AS c FROM names").rows()[0][0]
    e.execute("REFRESH MATERIALIZED VIEW names")
    return e.execute("SELECT COUNT(*) AS refreshed FROM names").df.withColumn("kept", F.lit(kept).cast("long"))


@query("SELECT COUNT(*) AS c, COUNT(*) AS ids, 1 AS low, CAST(COUNT(*) AS INTEGER) AS high FROM orders")
def ddl_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    e.execute("CREATE TABLE sales (id SERIAL PRIMARY KEY, price DOUBLE)")
    e.execute("INSERT INTO sales (price) SELECT o_totalprice FROM orders")
    return e.execute("SELECT COUNT(*) AS c, COUNT(DISTINCT id) AS ids, MIN(id) AS low, MAX(id) AS high FROM sales").df


@query("SELECT o_orderkey, o_totalprice, TRUE AS apart FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000")
def ddl_partition_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``apart``: whether each file holds rows of one range only."""
    e = engine(spark, sf_dir, "orders")
    e.execute("CREATE TABLE sales (o_orderkey BIGINT, o_totalprice DOUBLE) PARTITION BY RANGE (o_totalprice) (PARTITION low VALUES LESS THAN (100000), PARTITION mid VALUES LESS THAN (200000), PARTITION high VALUES LESS THAN MAXVALUE)")
    e.execute("INSERT INTO sales SELECT o_orderkey, o_totalprice FROM orders")
    files = e.schema("sales").read(spark, with_file=True).groupBy("_file").agg(F.min(range_shard(F.col("o_totalprice"), [100000, 200000])).alias("a"), F.max(range_shard(F.col("o_totalprice"), [100000, 200000])).alias("b"))
    apart = files.where("a <> b").isEmpty()
    return e.execute("SELECT * FROM sales WHERE o_totalprice >= 100000 AND o_totalprice < 200000").df.withColumn("apart", F.lit(apart))


@query("SELECT o_orderkey, TRUE AS double_outside, TRUE AS double_inside FROM orders WHERE o_custkey = 7 AND o_totalprice > 100000")
def index_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unique index on some rows lets others repeat its keys."""
    e = engine(spark, sf_dir, "orders")
    e.execute("CREATE TABLE o (o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE)")
    e.execute("INSERT INTO o SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
    e.execute("CREATE INDEX CONCURRENTLY dear ON o (o_custkey) WHERE o_totalprice > 100000")
    e.execute("CREATE UNIQUE INDEX once ON o (o_orderkey) WHERE o_totalprice >= 0")
    e.execute("INSERT INTO o VALUES (1, -1, -5), (1, -1, -5)")
    return e.index("dear").get(7).select("o_orderkey", F.lit(True).alias("double_outside"), F.lit(fails(ConstraintViolation, e.execute, "INSERT INTO o VALUES (1, -1, 5)")).alias("double_inside"))


@query("SELECT TRUE AS rejected, COUNT(*) AS c, 5::BIGINT AS cities FROM nation")
def fk_set_null_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET NULL into a column that must not be null fails as a whole."""
    e = nations(spark, sf_dir)
    e.execute("CREATE TABLE city (id INTEGER, nation INTEGER NOT NULL, FOREIGN KEY (nation) REFERENCES nation_t (n_nationkey) ON DELETE SET NULL)")
    e.execute("INSERT INTO city SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey < 5")
    rejected = fails(ConstraintViolation, e.execute, "DELETE FROM nation_t WHERE n_nationkey = 2")
    cities = e.execute("SELECT COUNT(nation) FROM city").rows()[0][0]
    return e.table("nation_t").agg(F.lit(rejected).alias("rejected"), F.count("*").alias("c"), F.lit(cities).cast("long").alias("cities"))


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 0 THEN 1 ELSE n_nationkey END AS nation FROM nation WHERE n_nationkey <> 0")
def fk_set_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("CREATE TABLE city (id INTEGER, nation INTEGER DEFAULT 1, FOREIGN KEY (nation) REFERENCES nation_t (n_nationkey) ON DELETE SET DEFAULT)")
    for part in ("n_nationkey > 0 AND n_regionkey = 0", "n_nationkey > 0 AND n_regionkey <> 0"):
        e.execute(f"INSERT INTO city SELECT n_nationkey, n_nationkey FROM nation WHERE {part}")
    before = set(e.schema("city").files)
    e.execute("DELETE FROM nation_t WHERE n_regionkey = 0 AND n_nationkey <> 1")
    if not before & set(e.schema("city").files):
        raise EngineError("files without rows that refer to what was deleted were written anew")
    return e.execute("SELECT id, nation FROM city").df


@query("SELECT TRUE AS rejected, n_nationkey AS id FROM nation WHERE n_nationkey < 5")
def upsert_referrer_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO UPDATE must not take a key away that other rows refer to."""
    e = engine(spark, sf_dir, "nation")
    e.execute("CREATE TABLE p (id INTEGER PRIMARY KEY, code INTEGER UNIQUE)")
    e.execute("CREATE TABLE c (id INTEGER, code INTEGER REFERENCES p (code))")
    e.execute("INSERT INTO p SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey < 5")
    e.execute("INSERT INTO c VALUES (1, 3)")
    rejected = fails(ConstraintViolation, e.execute, "INSERT INTO p VALUES (3, 77) ON CONFLICT (id) DO UPDATE SET code = EXCLUDED.code")
    return e.execute("SELECT code AS id FROM p").df.withColumn("rejected", F.lit(rejected))


@query("SELECT n_nationkey, n_name || chr(10) || '\"two\", lines' AS n_name FROM nation")
def import_csv_quoted_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) + "/lines.csv"
    io.export_csv(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat("n_name", F.lit('\n"two", lines')).alias("n_name")), path)
    return io.import_csv(spark, path, "n_nationkey:INTEGER,n_name:TEXT")


@query("SELECT COUNT(*) AS names, COUNT(*) AS placed, 4::BIGINT AS shards FROM (SELECT DISTINCT c_name FROM customer)")
def shard_hash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of any type: equal ones share a shard, and all shards are used."""
    placed = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name", hash_shard(F.col("c_name"), 4).alias("shard"))
    return placed.agg(F.count_distinct("c_name").alias("names"), F.count_distinct("c_name", "shard").alias("placed"), F.count_distinct("shard").alias("shards"))


@query("SELECT TRUE AS differ, 0 AS hits, 0 AS kept, COUNT(*) AS c FROM nation")
def cache_leaves_out_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation", cache=ResultCache())
    a, b = (e.execute("SELECT rand() AS r FROM nation").rows() for _ in range(2))
    e.execute("SELECT now() AS t")
    found = (F.lit(a != b).alias("differ"), F.lit(e.cache.hits).alias("hits"), F.lit(len(e.cache)).alias("kept"))
    return e.attached["nation"].agg(*found, F.count("*").alias("c"))


@query("SELECT 2 AS entries, 1 AS evictions, 3 AS insertions, 1 AS hits, 3 AS misses")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation", cache=ResultCache(max_entries=2))
    for k in (1, 2, 1, 3):
        e.execute(f"SELECT COUNT(*) AS c FROM nation WHERE n_regionkey = {k}")
    s = e.cache.stats()
    return spark.createDataFrame([tuple(s[k] for k in ("entries", "evictions", "insertions", "hits", "misses"))], "entries int, evictions int, insertions int, hits int, misses int")


@query("SELECT 1 AS dropped, 0 AS again, 0::BIGINT AS left_over")
def index_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("CREATE INDEX by_region ON nation_t (n_regionkey)")
    counts = [e.execute("DROP INDEX IF EXISTS by_region").affected_rows for _ in range(2)]
    return e.execute("SHOW INDEXES").df.agg(F.lit(counts[0]).alias("dropped"), F.lit(counts[1]).alias("again"), F.count("*").alias("left_over"))


@query("SELECT n_nationkey, n_regionkey FROM nation")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("CREATE INDEX by_region ON nation_t USING GIN (n_regionkey)")
    return e.index("by_region").scan().select("n_nationkey", "n_regionkey")


@query("SELECT COUNT(*) AS entries, 64 * COUNT(*) AS size, 2 AS lookups, 2 AS inserts, 1 AS deletes FROM (SELECT n_nationkey FROM nation UNION ALL SELECT 99)")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("CREATE INDEX by_region ON nation_t (n_regionkey)")
    e.execute("INSERT INTO nation_t VALUES (98, 'X', 1), (99, 'Y', 1)")
    e.execute("DELETE FROM nation_t WHERE n_nationkey = 98")
    e.index("by_region").get(1)
    e.index("by_region").range(1, 2)
    s = e.index("by_region").stats()
    return spark.createDataFrame([tuple(s[k] for k in ("entries", "size", "lookups", "inserts", "deletes"))], "entries long, size long, lookups int, inserts int, deletes int")


@query("SELECT n_nationkey FROM nation UNION ALL SELECT -1")
def ddl_drop_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nations(spark, sf_dir)
    e.execute("ALTER TABLE nation_t ADD CONSTRAINT positive CHECK (n_nationkey >= 0)")
    if not fails(ConstraintViolation, e.execute, "INSERT INTO nation_t VALUES (-1, 'X', 0)"):
        raise EngineError("the constraint did not hold")
    e.execute("ALTER TABLE nation_t DROP CONSTRAINT positive")
    e.execute("INSERT INTO nation_t VALUES (-1, 'X', 0)")
    return e.execute("SELECT n_nationkey FROM nation_t").df


@query("SELECT level, COUNT(*) AS c FROM nation, (VALUES ('READ UNCOMMITTED'), ('READ COMMITTED'), ('REPEATABLE READ'), ('SERIALIZABLE'), ('SNAPSHOT')) v(level) GROUP BY level")
def txn_isolation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels read the snapshot that the transaction began with."""
    e, found = nations(spark, sf_dir), []
    for i, level in enumerate(("READ UNCOMMITTED", "READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE", "SNAPSHOT")):
        reader = Engine(spark, e.warehouse)
        reader.execute(f"BEGIN TRANSACTION ISOLATION LEVEL {level}")
        e.execute(f"INSERT INTO nation_t VALUES ({100 + i}, 'X', 1)")
        found.append((level, reader.execute("SELECT COUNT(*) FROM nation_t").rows()[0][0]))
        reader.execute("ROLLBACK")
        e.execute(f"DELETE FROM nation_t WHERE n_nationkey = {100 + i}")
    return spark.createDataFrame(found, "level string, c long")


@query("SELECT TRUE AS late, COUNT(*) AS c FROM nation")
def txn_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = [0.0]
    e = engine(spark, sf_dir, "nation", transaction_seconds=10.0, clock=lambda: now[0])
    e.execute(NATION)
    e.execute("INSERT INTO nation_t SELECT n_nationkey, n_name, n_regionkey FROM nation")
    e.script("BEGIN; DELETE FROM nation_t")
    now[0] = 11.0
    late = fails(TransactionError, e.execute, "COMMIT")
    return e.table("nation_t").agg(F.lit(late).alias("late"), F.count("*").alias("c"))


@query("SELECT user_id, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'error') v WHERE rn = 1")
def mvcc_collect_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", (F.col("event_type") != "error").alias("committed"))
    return mvcc.collect_garbage(events, ["user_id"], "event_id", "committed", active=0).select("user_id", "event_id")


@query("""
SELECT step, ROUND(CAST(cost AS DOUBLE), 6) AS cost FROM (SELECT COUNT(*) AS n FROM orders) o, LATERAL (VALUES
  ('SeqScan', 1.5 * n * 0.01 * 0.5), ('IndexScan', 1.3 * (FLOOR(n * 0.1) * 4.0 + n * 0.01)), ('Sort', n * LOG2(n) * 0.01), ('Unknown', 15.0)) v(step, cost)
""")
def plan_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.functions.statistics import TableStats

    s, n = Statistics(), spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    s.update("orders", TableStats(n, 0))
    costs = {"SeqScan": s.cost("SeqScan", "orders", 0.5).total, "IndexScan": s.cost("IndexScan", "orders").total, "Sort": s.sort(n), "Unknown": s.cost("Filter", "orders").total}
    return spark.createDataFrame([(k, round(v, 6)) for k, v in costs.items()], "step string, cost double")


@query("SELECT * FROM (VALUES ('a', '=', TRUE), ('a', '>=', TRUE), ('a', 'LIKE', FALSE), ('b', '=', FALSE)) t(col, op, usable)")
def index_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("a", "="), ("a", ">="), ("a", "LIKE"), ("b", "=")]
    return spark.createDataFrame([(c, o, Statistics.can_use_index(c, o, ["a", "b"])) for c, o in cases], "col string, op string, usable boolean")


@query("SELECT * FROM (VALUES ('one', 1), ('two', 2)) t(name, executions)")
def prepared_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    e.script("PREPARE one AS SELECT $1 AS a; PREPARE two AS SELECT $1 + $2 AS a; PREPARE gone AS SELECT 1 AS a; EXECUTE one(1); EXECUTE two(1, 2); EXECUTE two(3, 4); DEALLOCATE gone")
    return spark.createDataFrame([(n, e.prepared.get(n).executions) for n in e.prepared.list()], "name string, executions int")


@query("SELECT event_type, DATE_TRUNC('day', ts) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.streaming.ingest import windowed_counts

    name = f"counts_{uuid.uuid4().hex}"
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet")
    counts = windowed_counts(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "1 hour")
    counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@query("SELECT CAST(COUNT(*) AS INTEGER) AS n, CAST(CEIL(COUNT(*) / 7.0) AS INTEGER) AS pages, 5 AS first FROM nation")
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in pages of seven rows, and at most five of them."""
    e = engine(spark, sf_dir, "nation")
    pages = list(io.pages(e.execute("SELECT n_nationkey FROM nation").df, 7))
    first = e.fetch("SELECT n_nationkey FROM nation", max_rows=5, timeout=300)
    return spark.createDataFrame([(sum(len(rows) for rows, _ in pages), len(pages), len(first))], "n int, pages int, first int")


@query("SELECT n_nationkey, n_nationkey * 2 + 1 AS odd FROM nation")
def function_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.functions import pandas_udf

    spark.udf.register("twice_and_one", pandas_udf(lambda s: s * 2 + 1, "int"))
    return engine(spark, sf_dir, "nation").execute("SELECT n_nationkey, twice_and_one(n_nationkey) AS odd FROM nation").df


@query("SELECT * FROM (VALUES ('nation'), ('nation_t')) t(name)")
def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).execute("SHOW TABLES").df


@query("SELECT '│ ' || r_regionkey || ' │ ' || rpad(r_name, CAST(w AS INTEGER), ' ') || ' │' AS line FROM region, (SELECT GREATEST(MAX(length(r_name)), 6) AS w FROM region)")
def console_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = io.console_table(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("k"), "r_name")).split("\n")
    return spark.createDataFrame([(x,) for x in lines[3:-1]], "line string")


@query("SELECT * FROM (VALUES ('1 row(s) affected'), ('2 row(s) affected'), ('error')) t(line)")
def command_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements over several lines, and an error after which the prompt goes on."""
    from lakemill.__main__ import prompt

    said: list[str] = []
    prompt(engine(spark, sf_dir), ["CREATE TABLE t\n", "(a INTEGER);\n", "NONSENSE;\n", "INSERT INTO t VALUES (1), (2);\n", "\\q\n", "DROP TABLE t;\n"], 10, said.append)
    return spark.createDataFrame([(x.split(":")[0],) for x in said if "affected" in x or x.startswith("error")], "line string")


@query("SELECT * FROM (VALUES ('compression', 'lz4'), ('shuffle_partitions', '64')) t(name, value)")
def configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakemill.config import load

    c = load([], {"LAKEMILL_COMPRESSION": "lz4", "LAKEMILL_SHUFFLE_PARTITIONS": "64"})
    return spark.createDataFrame([("compression", c.compression), ("shuffle_partitions", str(c.shuffle_partitions))], "name string, value string")


@query("SELECT n_nationkey, upper(n_name) AS n_name FROM nation WHERE n_regionkey <> 1")
def format_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation", format="orc")
    e.execute(NATION)
    e.execute("INSERT INTO nation_t SELECT n_nationkey, n_name, n_regionkey FROM nation")
    e.script("DELETE FROM nation_t WHERE n_regionkey = 1; UPDATE nation_t SET n_name = upper(n_name)")
    return e.execute("SELECT n_nationkey, n_name FROM nation_t").df


@query("SELECT TRUE AS planned, TRUE AS timed")
def explain_and_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    text = e.execute("EXPLAIN SELECT n_name FROM nation WHERE n_regionkey = 1").rows()[0][0]
    timed = e.profile("SELECT n_name FROM nation", 2)
    return spark.createDataFrame([("PushedFilters" in text, len(timed) == 2 and min(timed) > 0)], "planned boolean, timed boolean")


@query("SELECT 'orders' AS table_name, 'o_custkey' AS column_name, COUNT(*) AS row_count, COUNT(DISTINCT o_custkey) AS distinct_count, 0::BIGINT AS null_count, CAST(MIN(o_custkey) AS VARCHAR) AS min_value, CAST(MAX(o_custkey) AS VARCHAR) AS max_value FROM orders")
def stats_analyze_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    return e.execute("ANALYZE TABLE orders").df.where("column_name = 'o_custkey'").select("table_name", "column_name", "row_count", "distinct_count", "null_count", "min_value", "max_value")
