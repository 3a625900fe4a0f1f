import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakemill.llm import suffix_dedup as s


def brute(rows, length):
    seen, out = set(), []
    for i, x in rows:
        b = (x or "").encode()
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - length + 1):
            w = b[at : at + length]
            if w in seen:
                gone[at : at + length] = True
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_longest_previous_factor(symbols, length):
    seen, want = set(), []
    for i in range(len(symbols)):
        w = tuple(symbols[i : i + length])
        whole = len(w) == length and 0 not in w
        want.append(whole and w in seen)
        if whole:
            seen.add(w)
    assert s.has_earlier(np.array(symbols, "u2"), length).tolist() == want


@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.data())
@settings(max_examples=100, deadline=None)
def test_nearest_smaller(values, data):
    head = np.array([True] + [data.draw(st.booleans()) for _ in values[1:]])
    want = []
    for i, v in enumerate(values):
        begin = max(k for k in range(i + 1) if head[k])
        want.append(max([k for k in range(begin, i) if values[k] < v], default=-1))
    assert s.nearest_smaller(np.array(values), head).tolist() == want


def test_suffix_order_sorts_suffixes():
    x = np.random.default_rng(3).integers(1, 4, 200).astype("u2")
    order, rank = s.suffix_order(x, 30)
    keys = [tuple(x[i : i + 30].tolist()) for i in order]
    assert keys == sorted(keys)


@pytest.mark.parametrize("crowd", [4096, 1])
def test_against_brute_force(documents, monkeypatch, crowd):
    monkeypatch.setattr(s, "MOST_OF_CORE", crowd)
    docs = documents.where("doc_id IS NOT NULL AND doc_id <> 30")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    for length in (100, 40):
        got = sorted(tuple(r) for r in s.remove_repeats(docs, length).collect())
        assert got == brute(rows, length)
    assert sum(r[2] for r in brute(rows, 100)) > 0


def test_awkward_rows(documents, clashing, empty):
    got = s.remove_repeats(documents)
    assert got.count() == documents.count() and got.where("doc_id IS NULL").count() == 2
    full = s.remove_repeats(clashing, keep_columns=True)
    assert sorted(full.columns) == sorted(set(clashing.columns) - {"text"} | {"kept_text", "n_removed"})
    want = {(r.doc_id, r.n_bytes - r.n_removed) for r in got.where("doc_id < 30").collect()}
    assert {(r.doc_id, len(r.kept_text.encode())) for r in full.where("doc_id < 28").collect()} <= want
    assert full.where("doc_id = 1").first().source == "s1"
    assert s.remove_repeats(empty).count() == 0 and s.remove_repeats(empty, keep_columns=True).count() == 0
    both = s.remove_repeats(documents.where("doc_id = 30")).collect()  # two equal rows: one goes, but for nothing the other shares with itself
    assert sorted(r.n_removed for r in both)[-1] == 1500


def test_runs_of_long_texts_in_parts(monkeypatch):
    """Windows have the same anchors whatever is hashed at a time, and each is in one run."""
    rng = np.random.default_rng(1)
    sizes = np.array([0, 700, 30, 0, 2000, 120, 0])
    data = rng.integers(97, 101, sizes.sum()).astype("u1")

    def windows():
        r = s.Runs(data, sizes, 40)
        assert (s._mix(r.hash(r.p, 20), 0x94D049BB133111EB) != 0).all()
        return {int(w): (int(p), int(d), int(h)) for p, a, b, d, h in zip(r.p, r.a, r.b, r.doc, r.anchor, strict=True) for w in range(a, b + 1)}

    want = windows()
    assert len(want) == sum(max(n - 39, 0) for n in sizes)
    for part in (1, 50, 333):
        monkeypatch.setattr(s, "PART", part)
        assert windows() == want


def test_spans_are_compared_byte_by_byte(spark, documents):
    """A claim that a span repeats what it doesn't ends the job."""
    docs = documents.where("doc_id < 5").coalesce(1)
    blocks = s.make_blocks(docs, "doc_id", "text", [])
    row = blocks.first()
    text = s.zstandard.ZstdDecompressor().decompress(row.text)
    told = s._zip(np.array([[0], [0], [9], [3]], "i8"))
    squeeze = s.zstandard.ZstdCompressor().compress
    claim = lambda body: spark.createDataFrame([(row.block, 77, told, squeeze(body))], "source long, block long, spans binary, bytes binary")
    assert s.confirmed(blocks, claim(text[3:12]), 2).first().block == 77
    with pytest.raises(Exception, match="one hash"):
        s.confirmed(blocks, claim(text[4:13]), 2).collect()


def test_repeats_within_and_across_blocks(spark, monkeypatch):
    """Many small blocks: first copies in the same block, in others, and chained over several documents."""
    monkeypatch.setattr(s, "BLOCK_BYTES", 3000)
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    parts = [word(int(n)) for n in rng.integers(40, 400, 12)]
    rows = [(i, "".join(parts[int(k)] for k in rng.integers(0, 12, 6)) + word(30)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in s.remove_repeats(docs, 100).collect()) == brute(rows, 100)
