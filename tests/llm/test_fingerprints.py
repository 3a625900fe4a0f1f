import hashlib
import random

import numpy as np
import pytest

from lakemill.llm import fingerprints as f


@pytest.mark.parametrize("dtype", ["u1", "u8"])
def test_coin_tossing(dtype):
    x = np.random.default_rng(0).integers(0, 256 if dtype == "u1" else 2**63, 20_000).astype(dtype)
    x = x[np.concatenate([[True], x[1:] != x[:-1]])]
    head = np.zeros(len(x), bool)
    head[[0, 5000]] = True
    labels = f.tossed(x, head)
    same = labels[1:] == labels[:-1]
    assert labels.max() < 8 and not same[~head[1:]].any()
    sizes = np.diff(np.flatnonzero(f.phrases(x, head)))
    assert sizes.min() >= 1 and sizes.max() <= 14


def test_a_substring_has_the_same_phrases_wherever_it_stands():
    rng = random.Random(1)
    inner = bytes(rng.choices(range(97, 117), k=2000))
    for level in range(f.LEVELS):
        inside = None
        for before in (b"", b"x", b"some other text ", bytes(rng.choices(range(97, 117), k=333))):
            names = [n[t == 0].tolist() for n, t in [f.parse([before + inner + b" after"])[level]]][0]
            names = set(names)
            inside = names if inside is None else inside & names
        whole = set(f.parse([inner])[level][0].tolist())
        assert len(inside) > 0.7 * len(whole) - 4


def test_sketches_of_texts_are_those_of_each_alone():
    texts = ["hello world " * 40, "", "a", "aaaaaaaa", "é" * 100, "the end of it, at last; or not"]
    both = f.sketches(texts)
    for i, x in enumerate(texts):
        assert (f.sketches([x])[0] == both[i]).all()
    assert (both[1] == 0xFFFFFFFF).all()
    assert f.likeness(both, both).tolist() == [1.0] * len(texts)
    assert f.likeness(both[1:2], both[:1])[0] == 0


def test_likeness_follows_the_shared_share():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    a = [word() for _ in range(2000)]
    for share in (0.9, 0.5, 0.1):
        b = a[: int(2000 * share)] + [word() for _ in range(int(2000 * (1 - share)))]
        s = f.sketches([" ".join(a), " ".join(b)])
        assert abs(f.likeness(s[:1], s[1:])[0] - share / (2 - share)) < 0.2


def test_a_character_less_changes_little_at_every_length():
    """The mean likeness of 200 texts and the same without their last character, for each length: no step anywhere."""
    rng = random.Random(8)
    base = [" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(300)) for _ in range(200)]
    before = None
    for length in range(60, 701, 10):
        s = f.sketches([x[:length] for x in base] + [x[: length - 1] for x in base])
        mean = f.likeness(s[:200], s[200:]).mean()
        assert mean > 0.8
        assert before is None or abs(mean - before) < 0.1
        before = mean


MASK = 2**64 - 1


def mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & MASK
    return x ^ x >> 31


def plain_names(text):
    """All levels' phrase names by loops over one text, as the module's docstring tells it."""
    symbols, out = list(text.encode()), set()
    for level in range(4):
        runs = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [mix(x + (level + 1) * 0x9E3779B97F4A7C15 & MASK) for x, _ in runs]
        names = [mix(name + n & MASK) if n > 1 else name for name, (_, n) in zip(names, runs, strict=True)]
        labels = [x for x, _ in runs]
        for _ in range(4 if level else 3):
            left = [labels[0] ^ 1, *labels[:-1]] if labels else []
            place = [((x ^ y) & -(x ^ y)).bit_length() - 1 for x, y in zip(labels, left, strict=True)]
            labels = [2 * p + (x >> p & 1) for x, p in zip(labels, place, strict=True)]
        begins = [i for i, x in enumerate(labels) if i == 0 or i > 1 and x > labels[i - 1] and (i + 1 == len(labels) or x > labels[i + 1])]
        symbols = []
        for a, b in zip(begins, [*begins[1:], len(names)], strict=False):
            symbols.append(mix(sum(mix(names[i] + (i - a) * 0x94D049BB133111EB & MASK) for i in range(a, b)) & MASK))
        out |= {x >> 32 for x in symbols}
    return out


def plain_likeness(a, b):
    union = sorted(a | b)[:64]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def test_against_plain_code(documents):
    docs = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want = {}
    for k, (i, x) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(x) // 4
        edited = x[: len(x) - n] + following[:n]
        sets = [set(sorted(plain_names(t))[:64]) for t in (x, edited, following)]
        prints = ["".join(f"{v:08x}" for v in sorted(s) + [0xFFFFFFFF] * (64 - len(s))) for s in sets]
        want[i] = (len(x), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], round(plain_likeness(sets[0], sets[1]), 9), round(plain_likeness(sets[0], sets[2]), 9))
    got = f.with_next(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got} == want


def test_many_rows_of_one_id_are_dealt_out(spark):
    docs = spark.createDataFrame([(None, f"text number {i} of them all") for i in range(2000)], "doc_id long, text string")
    got = f.with_next(docs)
    assert got.count() == 2000 and got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 20).count() > 4


def test_awkward_rows(documents, clashing, empty):
    assert f.with_next(documents).count() == documents.count()
    assert f.with_next(clashing).columns[0] == "doc_id" and f.with_next(empty).count() == 0
    one = f.with_next(documents.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
