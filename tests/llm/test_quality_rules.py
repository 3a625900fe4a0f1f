import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakemill.llm.quality_rules import clean_lines

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    seen = {}
    for i in range(n - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in clean_lines(docs).collect()}
    assert got == {i: brute(x) for i, x in enumerate(texts)}


def test_counts_on_awkward_texts(spark, documents):
    check(spark, [r.text for r in documents.collect()])
    check(spark, ["a b c d e f g h " * 3, "a " * 9, "a " * 8, "x\ny\nx\n \nx", "  a b \x0b c\x1cd", "é😀 #|", " ".join(map(str, range(30))) + " " + " ".join(map(str, range(20)))])


def test_counts_on_random_texts(spark):
    @given(st.lists(st.text(alphabet="ab \n\t#|", max_size=120), min_size=1, max_size=40))
    @settings(max_examples=5, deadline=None)
    def run(texts):
        check(spark, texts)

    run()


def test_counts_on_test_documents(spark):
    check(spark, [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


PROSE = "The quick brown fox jumps over the lazy dog, and then it rests in the warm sun for a while.\nAnother sentence follows here, with some more words in it."


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("Home | News | Sport | Contact | About", True),
        ("A plain sentence, as they come.", False),
        ("Short title without a stop", False),
        ("Word*** other%%% thing### more&&& last$$$", True),
        ("BUY!! NOW!! THIS!! IS!! CHEAP!!", True),
        ("NASA and ESA agreed.", False),
        ("All rights reserved.", True),
        ("one two three four five six seven eight nine ten eleven twelve thirteen", True),
    ],
)
def test_lines(spark, line, fails):
    r = clean_lines(spark.createDataFrame([(f"{PROSE}\n{line}",)], "text string")).first()
    assert r.n_failed_lines == int(fails) and r.clean_text == (PROSE if fails else f"{PROSE}\n{line}") and r.kept


def test_documents_that_lose_too_much_are_rejected(spark):
    junk = "\n".join(" | ".join(f"{word}{i}" for word in ("Home", "News", "Sport", "Contact", "About", "Help", "Imprint", "Search")) for i in range(5))
    r = clean_lines(spark.createDataFrame([(f"{PROSE}\n{junk}",)], "text string")).first()
    assert not r.base_failed and not r.kept


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    good = clean_lines(docs).where("quality = 1 AND NOT base_failed")
    total, kept = good.selectExpr("count(*)", "count_if(kept)").first()
    assert kept / total > 0.995


def test_awkward_rows(documents, clashing, empty):
    assert clean_lines(documents).count() == documents.count()
    none = clean_lines(documents).where("doc_id = 24").first()
    assert none.clean_text == "" and none.n_words == 0 and none.base_failed and not none.kept
    assert clean_lines(clashing).count() == clashing.count() and clean_lines(empty).count() == 0


def test_no_python_on_the_executors(documents):
    plan = clean_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobinPartitioning", "")
