import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakemill.llm.packing import WordIds, best_first_fit, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 50), min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_first_fit_decreasing_is_the_plain_one(sizes):
    bins, offsets = best_first_fit(np.array(sizes), 50)
    free, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            free.append(50)
        want[i] = (k, 50 - free[k])
        free[k] -= sizes[i]
    assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets, strict=True))} == want


@pytest.mark.parametrize("text", ["Hello, world. It's 3.14!", "ÉCOLE école. École", "a.. b., c.' d.", "<|endoftext|> <|ENDOFTEXT|>.", "İstanbul ΑΣ. ſ K.", "x\x0by\x1cz\xa0w", "", "日本語。テスト.", "don't. we'll, 's."])
def test_words_give_the_texts_ids(text):
    ids = WordIds(PATH)
    assert np.frombuffer(ids.of(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def same(ids, texts):
    want = ids.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [x for x, w in zip(texts, want, strict=True) if np.frombuffer(ids.of(x), "<u4").tolist() != w.ids]


@pytest.mark.parametrize("end", [".", ",", "'S"])
def test_every_code_point_before_a_mark(end):
    points = [*range(0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200)]
    assert same(WordIds(PATH), [f"a{chr(c)}{end}" for c in points]) == []


def test_random_strings():
    """ASCII, Latin letters, combining marks after letters with and without a composed form, letters that change in NFC."""
    rng = random.Random(1)
    pool = [chr(i) for i in range(0x20, 0x7F)] * 2 + [chr(i) for i in range(0xC0, 0x370)] + list("éÉßİıſKÅ .,'क़ড়ऱ한한Σς") + list("HhTtJjWwYyIi") * 4
    texts = ["".join(rng.choices([*pool, "'s", "'LL", "<|endoftext|>", "<|EndOfText|>"], k=rng.randrange(1, 14))) for _ in range(60_000)]
    assert same(WordIds(PATH), texts) == []


def test_cache_is_bounded():
    ids = WordIds(PATH, most=50)
    for i in range(500):
        ids.of(f"w{i}x. {'y' * 100}{i}")
        assert len(ids) <= 60 and max(map(len, ids)) <= ids.LONGEST


def test_pieces_are_whole(documents):
    ids = WordIds(PATH)
    docs = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pack_documents(docs, PATH, capacity=256, group=8).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        want = np.array(ids.tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(want[at : at + p.length].tobytes())
            at += p.length
        assert at == len(want)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256


def test_awkward_rows(documents, clashing, empty):
    assert pack_documents(documents, PATH).selectExpr("sum(IF(start = 0, 1, 0))").first()[0] == documents.count()
    assert pack_documents(clashing, PATH).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pack_documents(empty, PATH).count() == 0
