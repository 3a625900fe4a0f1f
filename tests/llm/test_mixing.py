import math

import pytest
from pyspark.sql import functions as F

from lakemill.llm import mixing
from lakemill.llm.mixing import Mix, draw, exponent, mixed, n_tokens


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "word " * (1 + i % 7), "big" if i % 3 else ("mid" if i % 2 else f"s{i % 12}")) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def sources(df):
    return {r.source: r.t for r in df.groupBy("source").agg(F.sum(n_tokens(F.col("text"))).alias("t")).collect()}


def shares(d):
    total = sum(d.values())
    return {k: v / total for k, v in d.items()}


def test_entropy_target(spark, corpus):
    tokens = sources(corpus)
    table = spark.createDataFrame(list(tokens.items()), "key string, tokens long")
    for target in (0.8, 0.9, 0.99):
        alpha, found = exponent(table, Mix(entropy=target, most_repeats=None))
        p = shares(tokens)
        w = shares({k: v**alpha for k, v in p.items()})
        entropy = -sum(x * math.log(x) for x in w.values()) / math.log(len(w))
        own = -sum(x * math.log(x) for x in p.values()) / math.log(len(p))
        assert abs(entropy - max(target, own)) < 1e-3 and abs(found["entropy"] / math.log(len(w)) - entropy) < 1e-6


@pytest.mark.parametrize("limit", [1.0, 1.5, 3.0])
def test_repetition_limit(spark, corpus, limit):
    tokens = sources(corpus)
    table = spark.createDataFrame(list(tokens.items()), "key string, tokens long")
    alpha, found = exponent(table, Mix(entropy=None, most_repeats=limit))
    p = shares(tokens)
    w = shares({k: v**alpha for k, v in p.items()})
    repeats = {k: found["budget"] * w[k] / tokens[k] for k in w}
    assert max(repeats.values()) <= limit + 1e-6 and min(repeats.values()) >= 1 - 1e-6
    assert max(repeats.values()) > limit - 0.01


@pytest.mark.parametrize("budget", [None, 3000, 20_000])
def test_draws_meet_the_weights(corpus, budget):
    drawn, plan = draw(corpus, Mix(entropy=0.95, most_repeats=None, budget=budget, block_tokens=1000))
    got = sources(drawn)
    for r in plan.collect():
        want = r.turns * r.tokens
        assert want - 8 <= got.get(r.key[1:], 0) <= want + 1e-6  # up to one document below
    times = drawn.groupBy("doc_id", "source").count().groupBy("source").agg(F.min("count").alias("a"), F.max("count").alias("b")).collect()
    assert all(r.b - r.a <= 1 for r in times)
    assert drawn.groupBy("doc_id", "_pass").count().where("count > 1").count() == 0
    if budget is None:
        assert drawn.select("doc_id").distinct().count() == corpus.count()


def test_blocks_hold_the_weights(corpus):
    drawn, plan = draw(corpus, Mix(entropy=0.95, most_repeats=None, block_tokens=3000))
    weights = {r.key[1:]: r.weight for r in plan.collect()}
    for r in drawn.groupBy("_block").agg(F.sum(n_tokens(F.col("text"))).alias("t"), F.sum(F.when(F.col("source") == "big", n_tokens(F.col("text"))).otherwise(0)).alias("big")).collect():
        assert abs(r.big / r.t - weights["big"]) < 0.12


def test_awkward_rows(documents, clashing, empty):
    drawn, plan = draw(documents, Mix(entropy=0.9, most_repeats=2.0))
    assert {r.doc_id for r in drawn.collect()} >= {r.doc_id for r in documents.collect()}
    assert {r.key for r in plan.collect()} == {"n", "ss0", "ss1", "ss2", "ss3"}
    out = mixed(clashing, Mix())
    assert out.columns == clashing.columns and out.count() >= clashing.count()
    assert mixed(empty, Mix()).count() == 0
    assert mixed(documents.where("text IS NULL OR text = ''"), Mix()).count() == 3
    assert mixed(documents.where("source = 's0'"), Mix()).count() == documents.where("source = 's0'").count()


def test_repeatable(corpus):
    a, b = (sorted((r.doc_id, r._pass, r._position) for r in draw(corpus, Mix(budget=5000))[0].collect()) for _ in range(2))
    assert a == b


def test_pipeline_mixes_to_the_target_of_op10(spark):
    import corpus_pipeline

    rows = [(i, "word " * 10, "hot" if i < 1000 else f"s{i % 20}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = shares(sources(corpus_pipeline.source_weights(spark, docs, "")))
    entropy = -sum(x * math.log(x) for x in w.values()) / math.log(len(w))
    assert abs(entropy - 0.97) < 0.005


def test_against_a_plain_draw(spark):
    """Exponent by bisection over floats, passes and cut by walking each source in order."""
    rows = [(i, "w " * (1 + i * i % 11), f"s{min(i % 13, i % 7)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn, plan = draw(docs, Mix(entropy=0.98, most_repeats=None, budget=4000))
    tokens = {}
    for i, x, s in rows:
        tokens[s] = tokens.get(s, 0) + len(x.split())
    p = shares(tokens)
    entropy = lambda a: (lambda w: -sum(x * math.log(x) for x in w.values()) / math.log(len(w)))(shares({k: v**a for k, v in p.items()}))
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.98 else (low, mid)
    weight = shares({k: v**low for k, v in p.items()})
    place = {r.doc_id: r.p for r in docs.select("doc_id", mixing.place(mixing.source_key(F.col("source")), F.col("doc_id"), F.lit(0), Mix().seed).alias("p")).collect()}
    want = {}
    for s in tokens:
        left = 4000 * weight[s]
        passes = int(left / tokens[s])
        left -= passes * tokens[s]
        full = False
        for i, x, _ in sorted((r for r in rows if r[2] == s), key=lambda r: place[r[0]]):
            full = full or len(x.split()) > left
            want[i] = passes + (not full)
            left -= 0 if full else len(x.split())
    got = {r.doc_id: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}
