import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A small corpus with the awkward cases: nulls in every column, empty and blank texts, ties, repeated rows, a long text."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "Iota", "kappa,", "lambda.", "mué", "nü", "xi\n"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "a", "b", "cd"]) for _ in range(n))
    base = [prose(rng.randrange(30, 200)) for _ in range(12)]
    rows = [(i, x, "en" if i % 3 else "fr", f"s{i % 4}", len(x)) for i, x in enumerate(base)]
    shared = prose(60)
    rows += [
        (20, base[0], "en", "s0", 1),
        (21, base[0] + " end", "en", "s0", 1),
        (22, f"{base[1]} {shared}", "fr", None, 1),
        (23, f"{shared} {base[2]} {shared}", None, "s1", None),
        (24, None, "en", "s1", 0),
        (25, "", None, None, 0),
        (26, " \t\n", "en", "s2", 3),
        (27, "12345 !!!", "en", "s2", 9),
        (28, "é", "fr", "s2", 1),
        (29, prose(4000), "en", "s0", 9),
        (30, "word " * 300, "en", "s0", 9),
        (30, "word " * 300, "en", "s0", 9),
        (None, base[3], "en", "s3", 9),
        (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(documents):
    """Extra columns with names that operators use for their own."""
    from pyspark.sql import functions as F

    names = ["score", "predicted", "lang_pred", "fp", "kept", "n_words", "clean_text", "kept_text", "n_removed", "length", "start", "sequence_id", "key", "place", "block", "_text", "class_id", "rep"]
    return documents.withColumns({n: F.lit(1) for n in names})
