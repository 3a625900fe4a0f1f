import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.llm import quality_classifier as q
from lakemill.llm import queries_op3_toxicity as op3
from lakemill.llm import queries_op9_quality_classifier as op9
from lakemill.llm import toxicity as t

SF = "/root/testdata/sf0.1"


def accuracy(spark, got, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    joined = got.where("held_out").join(labels, "doc_id")
    return {r[label]: r["right"] for r in joined.groupBy(label).agg(F.avg(F.when(F.col("predicted") == F.col(label), 1.0).otherwise(0.0)).alias("right")).collect()}


def test_toxicity_held_out(spark):
    got = op3.query(spark, SF)
    right = accuracy(spark, got, "toxic")
    assert right[0] > 0.98 and right[1] > 0.9
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR (predicted = 1) <> (score >= 0.5)").count() == 0


def test_quality_held_out(spark):
    got = op9.query(spark, SF)
    right = accuracy(spark, got, "quality")
    assert right[0] > 0.95 and right[1] > 0.98
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR (predicted = 1) <> (score >= 0.3)").count() == 0


def test_machine_learns_a_pair_that_no_sum_can():
    """Toxic only where both terms or neither are there: additive weights get half of it."""
    rng = np.random.default_rng(0)
    a, b = t._CELLS["insult"][0], t._CELLS["group"][0]
    noise = [t._CELLS[f"word{i}"][0] for i in range(50)]
    sets, labels = [], []
    for _ in range(2000):
        x, y = rng.random(2) < 0.5
        sets.append(np.array(sorted({*rng.choice(noise, 5)} | ({a} if x else set()) | ({b} if y else set())), "u4"))
        labels.append(int(x and y) if rng.random() < 0.99 else 0)
    labels = np.array(labels)
    features = np.array(sorted({*noise, a, b}))
    m = t.fit(features, t.rows_of(sets, t.place_of(features), len(features)), labels, np.ones(len(labels)), epochs=60)
    rows = t.rows_of([np.array([a]), np.array([b]), np.array(sorted([a, b]))], m.place(), len(m.features))
    raw = m.raw(rows)
    assert raw[2] > 0 > max(raw[0], raw[1])
    pair = m.factors[m.place()[a]] @ m.factors[m.place()[b]]
    assert abs(pair) > 0.1


def test_machine_against_loops():
    """The pair part by a loop over all pairs of features that a text has."""
    rng = np.random.default_rng(3)
    m = t.FactorizationMachine(np.arange(20), 0.3, rng.normal(size=20).astype("f4"), rng.normal(size=(20, 4)).astype("f4"))
    rows = (rng.random((30, 20)) < 0.3).astype("f4")
    for x, raw in zip(rows, m.raw(rows), strict=True):
        on = np.flatnonzero(x).tolist()
        want = 0.3 + sum(m.linear[i] for i in on) + sum(m.factors[i] @ m.factors[j] for i in on for j in on if i < j)
        assert abs(raw - want) < 1e-3


def test_features_against_loops(spark):
    rng = np.random.default_rng(4)
    sets = [np.flatnonzero(rng.random(40) < (0.1 + 0.02 * (i % 2) * np.arange(40))).astype("u4") for i in range(300)]
    labels = [i % 2 for i in range(300)]
    table = spark.createDataFrame([(y, s.astype("<u4").tobytes()) for s, y in zip(sets, labels, strict=True)], "label int, cells binary")
    n1, n0, z = 150, 150, {}
    for c in range(40):
        pos, neg = (sum(c in s for s, y in zip(sets, labels, strict=True) if y == k) for k in (1, 0))
        if pos + neg >= 4:
            p = (pos + neg + 1) / 302
            z[c] = abs(pos / n1 - neg / n0) / (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5
    best = sorted((c for c in z if z[c] > 3), key=lambda c: (-z[c], c))
    assert len(best) > 10
    for most in (5, 100):
        assert t.features_of(table, n1, n0, most).tolist() == sorted(best[:most])


def test_scores_against_one_text_at_a_time(spark, documents):
    """Whole tables against the model applied to each text by itself."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    m = t.train(documents, labels, "toxic")
    for r in t.score(documents, m).collect():
        on = {int(m.place()[c]) for c in t.cells_of(r.text or "")} - {len(m.features)}
        raw = m.bias + sum(m.linear[i] for i in on) + sum(m.factors[i] @ m.factors[j] for i in on for j in on if i < j)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-3
    b = q.train(documents, labels, "toxic")
    for r in q.score(documents, b).collect():
        shape, cells = q.features_of(r.text or "")
        values = [min(max((x - mean) / scale, -5), 5) for x, mean, scale in zip(shape, b.mean, b.scale, strict=True)]
        values += [float(x > e) for x, edges in zip(shape, b.edges, strict=True) for e in edges] + list(cells)
        s = sum(v * w for v, w in zip(values, b.weights, strict=True))
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(s - b.cut + np.log(0.3 / 0.7), -30, 30)))) < 1e-6


def test_bradley_terry_gradient():
    """The loss that the weights minimise, over all pairs: no step along any axis lowers it much."""
    rng = np.random.default_rng(5)
    shape, labels = rng.normal(size=(60, len(q.SHAPE))), np.arange(60) % 2
    shape[:, 0] += labels
    m = q.fit(shape, np.zeros((60, q.CELLS)), labels, np.ones(60), ridge=0.1, steps=2000)
    x = m.expand(shape, np.zeros((60, q.CELLS)))

    def loss(w):
        s = x @ w
        pairs = [np.log1p(np.exp(-(s[i] - s[j]))) for i in np.flatnonzero(labels == 1) for j in np.flatnonzero(labels == 0)]
        return np.mean(pairs) + 0.05 * w @ w

    best = loss(m.weights)
    assert best < loss(np.zeros(len(m.weights)))
    for axis in range(0, 12):
        step = np.zeros(len(m.weights))
        step[axis] = 0.05
        assert loss(m.weights + step) > best - 2e-3 and loss(m.weights - step) > best - 2e-3


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(1)
    shape = rng.normal(size=(400, len(q.SHAPE)))
    labels = (shape[:, 3] > 0).astype(int)
    m = q.fit(shape, np.zeros((400, q.CELLS)), labels, np.ones(400))
    s = m.strength(shape, np.zeros((400, q.CELLS)))
    assert s[labels == 1].min() > np.quantile(s[labels == 0], 0.95)
    assert abs((s < m.cut).mean() - (labels == 0).mean()) < 0.02


@pytest.mark.parametrize(("module", "label"), [(t, "toxic"), (q, "quality")])
def test_awkward_rows(spark, documents, clashing, empty, module, label):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, None), (None, 1), (2, 7)], f"doc_id long, {label} int")
    model = module.train(documents, labels, label)
    got = module.score(documents, model)
    assert got.count() == documents.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    texts = {}
    for r in got.collect():
        assert texts.setdefault(r.text or "", r.score) == r.score
    assert sorted(module.score(clashing, model).columns) == sorted(clashing.columns)
    assert module.score(empty, model).count() == 0
    for few in (labels.limit(0), labels.where(f"{label} = 1")):
        assert module.score(documents, module.train(documents, few, label)).count() == documents.count()
    assert module.score(documents, module.train(empty, labels, label)).count() == documents.count()


def test_selected_against_sort():
    rng = np.random.default_rng(6)
    for kind, widths in (("f4", (12, 7, 7, 6)), ("f8", (16, 16, 16, 16))):
        values = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-8, 8, 3000), np.zeros(200), -np.zeros(200), np.full(300, -1.5), [1e30, -1e30]]).astype(kind)
        ranks = np.array([0, 1, 5, 1700, 1701, 2000, 3700, 3701, 3701])
        blocks = [(values[i : i + 500], None) for i in range(0, len(values), 500)]
        both = q.selected(blocks, lambda x, y: [q.keys_of(x), q.keys_of(-x)], [ranks, ranks[:3]], widths)
        assert q.floats_of(both[0], kind).tolist() == np.sort(values)[ranks].tolist()
        assert q.floats_of(both[1], kind).tolist() == np.sort(-values)[ranks[:3]].tolist()


def test_quality_learns_from_every_labelled_row(spark):
    """Bins, scale, weights and cut against numpy over all of 17,000 labelled rows, 14,000 of one class."""
    rng = np.random.default_rng(8)
    words = ["alpha", "beta", "Gamma", "delta.", "EPS", "zeta,", "eta\n", "theta!", "42", "#"]
    texts = [" ".join(rng.choice(words, rng.integers(3, 30))) for _ in range(17_000)]
    rank = np.argsort(np.argsort([x.count("a") / len(x) + e for x, e in zip(texts, rng.normal(0, 0.05, len(texts)), strict=True)]))
    y = (rank >= 3000).astype(int)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(5)
    m = q.train(docs, spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "doc_id long, quality int"))
    found = [q.features_of(x) for x in texts]
    shape, cells = np.array([a for a, _ in found], "f8"), np.array([b for _, b in found], "f8")
    even = np.concatenate([np.quantile(shape[y == k], np.linspace(0, 1, 11), axis=0) for k in (0, 1)])
    assert np.allclose(m.edges, np.quantile(even, np.linspace(0, 1, 11)[1:-1], axis=0).T, rtol=1e-9, atol=1e-12)
    assert np.allclose(m.mean, shape.mean(0)) and np.allclose(m.scale, shape.std(0) + 1e-6)
    x = m.expand(shape, cells)
    s = x @ m.weights
    assert abs(m.cut - np.sort(s)[2999:3001].mean()) < 1e-9
    pull = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0][None]))
    gradient = x[y == 0].T @ pull.mean(0) / 3000 - x[y == 1].T @ pull.mean(1) / 14_000 + 1e-3 * m.weights
    assert np.abs(gradient).max() < 1e-4
