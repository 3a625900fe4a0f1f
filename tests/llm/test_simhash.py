import itertools

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lakemill.llm import near_dedup, simhash
from lakemill.llm.components import components


def plain_fingerprint(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def reach(nodes, linked):
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in itertools.combinations(nodes, 2):
            if linked(a, b):
                root[a] = root[b] = min(root[a], root[b])
    return root


def test_fingerprints(documents):
    for n in (3, 5):
        for r in simhash.with_fingerprints(documents, n).collect():
            assert r.fp % 2**64 == plain_fingerprint(r.text, n)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=8), st.data())
@settings(max_examples=40, deadline=None)
def test_links_within_a_cell_connect_what_all_pairs_connect(base, data):
    fps = set(base)
    for x in base:
        for _ in range(data.draw(st.integers(0, 4))):
            for _ in range(data.draw(st.integers(1, 3))):
                x ^= 1 << data.draw(st.integers(0, 63))
            fps.add(x)
    fps = np.array(sorted(fps), "u8").view("i8")
    near = lambda a, b: (a ^ b).bit_count() <= 2
    want = reach([int(x) % 2**64 for x in fps], near)
    for a, b in (simhash.neighbours(fps), simhash.linked_in_cells(np.zeros(len(fps), "i8"), fps, 2)):
        edges = {(int(x) % 2**64, int(y) % 2**64) for x, y in zip(a, b, strict=True)}
        assert all(near(x, y) for x, y in edges)
        assert reach(list(want), lambda x, y, e=edges: (x, y) in e or (y, x) in e) == want


def test_grid_join_finds_all_within_two_bits(spark, monkeypatch):
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(-(2**62), 2**62, 60)}
    for x in list(fps):
        for bits in ((1,), (5, 40), (0, 63), (2, 3, 4)):
            y = x
            for b in bits:
                y ^= (1 << b) - (1 << 64) * (b == 63)
            fps.add(y)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    near = lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2
    want = reach(sorted(fps), near)
    for all_pairs in (64, 1):
        monkeypatch.setattr(simhash, "ALL_PAIRS", all_pairs)
        edges = {(r.a, r.b) for r in simhash.near_links(df).collect()}
        assert reach(sorted(fps), lambda x, y, e=edges: (x, y) in e or (y, x) in e) == want


@given(st.text("ab \n\u00e9", max_size=60), st.integers(1, 4), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_long_texts_are_hashed_in_parts(text, shingle, most):
    lists, part = simhash.word_lists, simhash.PART
    want = simhash.shingle_hashes(text, shingle)
    try:
        simhash.word_lists, simhash.PART = (lambda data: lists(data, most)), most
        assert (simhash.shingle_hashes(text, shingle) == want).all()
        assert int.from_bytes(simhash.fingerprint(want), "big") == plain_fingerprint(text, shingle)
    finally:
        simhash.word_lists, simhash.PART = lists, part


def test_components(spark, documents):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(30)] + [(int(a), int(b)) for a, b in rng.integers(200, 300, (60, 2))] + [(7, 7), (500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    root = {x: x for x in nodes}
    for _ in range(len(nodes)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(documents, clashing, empty):
    rows = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    fp = {r.doc_id: plain_fingerprint(r.text, 3) for r in rows}
    want = reach(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents).where("doc_id IS NOT NULL").collect()}
    assert got == want
    assert simhash.near_duplicates(documents).count() == documents.count()
    assert simhash.near_duplicates(clashing).columns == ["doc_id", "fp", "component_id"]
    assert simhash.near_duplicates(empty).count() == 0


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_jaccard_classes_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for a, b in itertools.combinations(sorted(ids), 2)}
    pairs = [p for p in pairs if alike(sets[p[0]], sets[p[1]])]
    root = {i: i for i in sets}
    for _ in range(6):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    kept = {r.doc_id for r in near_dedup.without_duplicates(docs).collect()}
    assert len(pairs) > 10 and kept == {i for i in sets if root[i] == i}


def test_large_group_of_copies_keeps_one(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", 8)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in rng.integers(0, 10_000, 300)]
    rows = [(0, " ".join(words))]
    for i in range(1, 60):
        copy = list(words)
        copy[int(rng.integers(0, 300))] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join([*words[:30], *(f"own{i}x{k}" for k in range(200))])) for i in range(40)]  # share a passage only
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.without_duplicates(docs).collect()) == [0, *range(1000, 1040)]


def test_near_dedup_awkward_rows(documents, clashing, empty):
    kept = near_dedup.without_duplicates(documents)
    assert kept.columns == documents.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 20 not in ids and 21 not in ids and 0 in ids and 29 in ids
    assert ids.count(30) == 2 and kept.where("doc_id IS NULL").count() == 2
    assert [i for i in ids if i in (24, 25, 26)] == [24]  # texts without words are alike
    assert sorted(near_dedup.without_duplicates(clashing).columns) == sorted(clashing.columns)
    assert near_dedup.without_duplicates(empty).count() == 0
