import pytest
from pyspark.sql import functions as F

from lakemill.llm import queries_op5_sharding as op5
from lakemill.llm.sharding import CommitConflict, Shard, ShardStore


def store(spark, tmp_path, **options):
    return ShardStore(spark, f"file://{tmp_path}/store", **options)


def test_round_trip_and_compaction(spark, tmp_path, documents):
    s = store(spark, tmp_path, target=64_000, fan_in=3, tier=3, least=2_000)
    for _ in range(5):
        s.append(documents)
        s.compact(documents.schema)
        assert not s.due(s.shards())
    want = sorted(map(str, documents.collect())) * 5
    got = s.read(documents.schema)
    assert sorted(map(str, got.collect())) == sorted(want)
    assert sum(x.rows for x in s.shards()) == len(want)
    assert len(s.shards()) < 15


def test_readers_keep_their_version(spark, tmp_path, documents):
    s = store(spark, tmp_path, fan_in=2)
    first = s.append(documents)
    s.append(documents.limit(3))
    s.compact(documents.schema)
    assert s.read(documents.schema, first).count() == documents.count()
    assert s.expire(keep=1) > 0
    assert s.versions() == [max(s.versions())]
    assert s.read(documents.schema).count() == documents.count() + 3


def test_one_of_two_writers_wins(spark, tmp_path, documents):
    s = store(spark, tmp_path)
    base = s.append(documents)
    s.commit(base, s.shards(), "one")
    with pytest.raises(CommitConflict):
        s.commit(base, [], "two")
    assert s.read(documents.schema).count() == documents.count()
    assert not [n for n in (tmp_path / "store/manifest").iterdir() if "draft" in n.name and not n.name.endswith(".crc")]


def test_tiers():
    s = ShardStore.__new__(ShardStore)
    s.target, s.fan_in, s.tier, s.least = 1000, 2, 4, 10
    sized = lambda n: Shard("", 1, n)
    assert [s.tier_of(sized(n)) for n in (1, 10, 11, 40, 41, 499, 500, 2000)] == [0, 0, 1, 1, 2, 3, None, None]
    assert s.due([sized(5), sized(9), sized(30), sized(700), sized(800)]) == [[sized(5), sized(9)]]


def test_awkward_rows(spark, tmp_path, clashing, empty):
    s = store(spark, tmp_path)
    s.append(empty)
    assert s.read(empty.schema).count() == 0 and s.compact(empty.schema) == 1
    t = ShardStore(spark, f"file://{tmp_path}/other")
    assert t.read(clashing.schema).count() == 0
    t.append(clashing)
    assert t.read(clashing.schema).columns == clashing.columns


def test_query_holds_every_document_once(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    got = op5.query(spark, sf)
    assert got.select("doc_id", "n_bytes").exceptAll(docs).count() == 0 and got.count() == docs.count()
    assert got.where("NOT shard_ok").count() == 0


def test_merges_stay_near_the_target():
    s = ShardStore.__new__(ShardStore)
    s.target, s.fan_in, s.tier, s.least = 128, 4, 4, 1
    shards = [Shard(f"{i}", 1, 63) for i in range(7)] + [Shard(f"x{i}", 1, n) for i, n in enumerate((1, 1, 1, 2, 3, 20, 40, 60, 61, 62))]
    for _ in range(50):
        due = s.due(shards)
        if not due:
            break
        for group in due:
            assert len(group) > 1 and sum(x.bytes for x in group) <= s.target
            shards = [x for x in shards if x not in group] + [Shard(f"m{group[0].path}", 1, sum(x.bytes for x in group))]
    assert not s.due(shards) and sum(x.bytes for x in shards) == 7 * 63 + 251


def test_appends_of_two_writers_are_both_kept(spark, tmp_path, documents, monkeypatch):
    a, b = store(spark, tmp_path), store(spark, tmp_path)
    b.append(documents)
    stale, read = a.manifest(0), a.manifest
    calls = iter([stale])
    monkeypatch.setattr(a, "manifest", lambda *x: next(calls, None) or read(*x))
    assert a.append(documents) == 2  # another had taken version 1
    assert a.read(documents.schema).count() == 2 * documents.count()


def test_sweep_takes_only_what_nothing_lists(spark, tmp_path, documents):
    s = store(spark, tmp_path)
    s.append(documents)
    lost = s._write(documents.limit(2))
    assert lost and s.sweep(older_than=3600) == 0
    assert s.sweep(older_than=-1) == 1
    assert s.read(documents.schema).count() == documents.count()
