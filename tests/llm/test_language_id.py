import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.llm import language_id
from lakemill.llm import queries_op2_language_id as op2
from lakemill.llm.language_id import WIDTH, fit, predict, presence, train

SF = "/root/testdata/sf0.01"


def test_presence_is_that_of_each_text_alone():
    texts = ["Hello there", "", "é", "abcabc", "a", "12 34", "x" * 5000]
    both = presence(texts)
    assert both.shape == (len(texts), WIDTH) and set(both.ravel().tolist()) <= {0, 1}
    for i, x in enumerate(texts):
        assert (presence([x])[0] == both[i]).all()
    assert (presence(["abc"]) == presence(["ABC"])).all()


def test_kernel_against_sets():
    """Blended spectrum by sets of n-grams: shared ones over the root of the product of the numbers, for each length."""
    texts = ["hello there, world", "Hello World", "völlig anders", "a", "", "the the the"]

    def grams(x, n):
        b = x.lower().encode().translate(language_id.LETTERS)
        return {b[i : i + n] for i in range(len(b) - n + 1)}

    rows = language_id._normalised(presence(texts))
    got = rows @ rows.T
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            want = sum(len(grams(x, n) & grams(y, n)) / max(len(grams(x, n)) * len(grams(y, n)), 1) ** 0.5 for n in (2, 3, 4)) / 3
            assert abs(got[i, j] - want) < 0.05  # cells are shared by a few n-grams


@pytest.mark.parametrize("part", [1, 2, 7, 50])
def test_long_texts_are_hashed_in_parts(monkeypatch, part):
    texts = ["Hello there", "", "é", "abcabc", "a", "12 34", "xyz" * 50]
    want = presence(texts)
    monkeypatch.setattr(language_id, "PART", part)
    assert (presence(texts) == want).all()


def test_scores_against_loops():
    """Predictions by sums over landmarks one at a time; the weights solve the ridge equations."""
    texts = [f"{w} {w}s of the {w}" for w in ("house", "garden", "river")] * 4 + [f"{w} und die {w}en" for w in ("Haus", "Garten", "Fluss")] * 4
    langs = ["en"] * 12 + ["de"] * 12
    bits = np.packbits(presence(texts), axis=1)
    m = fit(langs, bits, landmarks=6)
    marks, rows = m.unpacked(), presence(["the gardens of the house", "die Gartenhaus und"])
    got = m.scores(rows, marks)
    for i, row in enumerate(language_id._normalised(rows)):
        for k in range(2):
            want = m.weights[-1][k] + sum(float(row @ mark) * m.weights[j][k] for j, mark in enumerate(marks))
            assert abs(got[i, k] - want) < 1e-3
    assert [m.languages[k] for k in got.argmax(1)] == ["en", "de"]


def test_all_languages_are_learned(spark):
    rows = [(i, f"{'abcdefghij'[k % 10] * 3}{'klmnopqrst'[k // 10] * 3} " * 20, f"l{k:02d}") for k in range(100) for i in range(k * 20, k * 20 + 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    assert len(model.languages) == 100
    got = predict(docs, model)
    assert got.where("lang_pred = lang").count() > 0.95 * len(rows)
    few = train(docs, most_rows=150)
    assert len(few.languages) == 100


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op2.query(spark, SF).join(docs, "doc_id")
    total, right = got.where("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert total > 100 and right / total > 0.97
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_awkward_rows(documents, clashing, empty):
    model = train(documents)
    assert model.languages == ["en", "fr"]
    got = predict(documents, model)
    assert got.count() == documents.count()
    for r in got.collect():
        blank = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == blank and (0 <= r.score <= 1) and (r.score == 0 or not blank)
    assert sorted(predict(clashing, model).columns) == sorted(clashing.columns)
    assert predict(empty, model).count() == 0
    none = train(empty)
    assert none.languages == [] and {r.lang_pred for r in predict(documents, none).collect()} == {"und"}
    assert fit([], presence([])).languages == []


def test_one_language(documents):
    model = train(documents.where("lang = 'fr'"))
    assert {r.lang_pred for r in predict(documents, model).collect()} == {"fr", "und"}


def test_pipeline_rejects_what_is_like_no_language(spark):
    import random

    import corpus_pipeline

    rng = random.Random(4)
    letters = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 10))) for _ in range(100))
    strange = [
        "我们今天去公园散步天气很好大家都很高兴然后回家吃饭看书睡觉" * 3,
        "Сегодня мы пошли гулять в парк и было очень хорошо потом вернулись домой и читали книги",
        "ذهبنا اليوم إلى الحديقة وكان الطقس جميلا ثم عدنا إلى البيت وقرأنا الكتب",
        letters,
        "".join(rng.choices("0123456789abcdef", k=3000)),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**9 + 5 * i + j, x) for i, x in enumerate(strange) for j in range(5)], "doc_id long, text string")
    kept = corpus_pipeline.languages(spark, docs.unionByName(extra, allowMissingColumns=True), SF)
    assert kept.where(f"doc_id >= {10**9}").count() == 0
    blank = sum(not any(c.isalpha() for c in r.text or "") for r in docs.select("text").collect())
    assert kept.count() == docs.count() - blank
