import random

import pytest

from lakemill.llm import near_dedup
from lakemill.llm.near_dedup import duplicates


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def classes(texts, least=0.8):
    """Class of every text by comparing all pairs."""
    sets, label = [shingles(x) for x in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("own", [24, 36, 60])
def test_near_copies_inside_a_large_family_of_one_template(spark, monkeypatch, own):
    """A key with many buckets' documents: near copies that the deal separates are found all the same."""
    monkeypatch.setattr(near_dedup, "BUCKET", 8)
    rng = random.Random(own)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    template = [word() for _ in range(170)]
    texts = []
    for _ in range(60):
        mine = [word() for _ in range(own)]
        texts += [" ".join(template + mine), " ".join(template + mine[:-1] + [word()])]
    rng.shuffle(texts)
    want = {i: c for i, c in enumerate(classes(texts))}
    assert len(set(want.values())) == 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in duplicates(docs).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_many_near_copies_and_texts_without_words(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", 8)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base = [word() for _ in range(200)]
    texts = [" " * i for i in range(30)]
    for _ in range(60):
        x = list(base)
        for i in rng.sample(range(200), rng.randrange(9)):
            x[i] = word()
        texts.append(" ".join(x))
    want = {i: c for i, c in enumerate(classes(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in duplicates(docs).collect()}
    assert {i: got.get(i, i) for i in want} == want


@pytest.mark.parametrize("bucket", [64, 1024, 10**9])
def test_all_pairs_of_a_large_family_whatever_a_bucket_holds(spark, monkeypatch, bucket):
    """2,000 pairs of near copies (similarity about 0.97) among 4,000 documents of one template (0.69 across)."""
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    template, rows = [word() for _ in range(200)], []
    for i in range(2000):
        mine = [word() for _ in range(42)]
        rows += [(2 * i, " ".join(template + mine)), (2 * i + 1, " ".join(template + mine[:-2] + [word(), mine[-1]]))]
    assert 0.6 < len(shingles(rows[0][1]) & shingles(rows[2][1])) / len(shingles(rows[0][1]) | shingles(rows[2][1])) < 0.75
    got = {r.doc_id: r.class_id for r in duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(4000)}


def test_repeated_ids_link_by_each_of_their_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    a, b, c = ([word() for _ in range(150)] for _ in range(3))
    near = lambda x: " ".join([*x[:-1], word()])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (8, near(b)), (9, " ".join(c)), (10, near(c)), (11, None), (12, "")]
    got = {r.doc_id: r.class_id for r in duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 7: 5, 8: 5, 9: 9, 10: 9, 11: 11, 12: 11}
