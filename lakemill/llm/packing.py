"""Packing documents into fixed-length token sequences.

First-fit decreasing over a tournament tree of bin capacities. Pieces are dealt to partitions by a hash of
their document, ordered by a second hash and taken in groups of ``group`` pieces, each packed on its own:
a group is a random sample of the corpus, so it has short pieces to fill the gaps of its long ones, and its
size bounds the memory of a task whatever the corpus.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import prepare, slices

#: Words kept by a worker's tokenizer cache before it starts again.
CACHE_WORDS = 1_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def best_first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """First-fit decreasing: (bin, offset) of each piece.

    The tree's leaves are the bins' free capacities and each inner node holds the maximum below it, so the
    first bin that fits is found, and its free space updated, in one walk of the tree's height.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, "i8"), np.zeros(n, "i8")
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def _steady(c: str) -> bool:
    """Whether c is a letter that NFC leaves alone and lower-casing makes one letter of the same blocks."""
    low = c.lower()
    return c.isalpha() and len(low) == 1 and low.isalpha() and ord(low) < 0x250 and unicodedata.is_normalized("NFC", c) and unicodedata.is_normalized("NFC", low)


#: Letters of Latin scripts beyond ASCII that are simple to normalise; words of these and ASCII are cut here.
LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if _steady(c))
PLAIN = re.compile(f"[!-~{LATIN}]+")
#: The vocabulary's own rule for cutting a word into pieces, for the letters and digits that PLAIN words have.
CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z{LATIN}]+|[0-9]|[^A-Za-z0-9{LATIN}]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others by
    the code points from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in shown)
    moved = {b: 256 + i for i, b in enumerate(rest)}
    return [chr(moved.get(b, b)) for b in range(256)]


#: The same for Latin-1 decoded text, as str.translate takes it.
BYTE_LETTERS = dict(enumerate(byte_letters()))


class WordIds(dict):
    """Token ids of words between ASCII white space, as little-endian unsigned 32-bit bytes.

    The tokenizer never joins across white space, so the ids of a text are those of its words in a row. It normalises
    to NFC, lower-cases, and cuts a word into pieces of letters, single digits and other marks, which are merged one
    by one. Words of ASCII and simple Latin letters, which NFC leaves alone, are cut here and share the ids of their
    pieces; the tokenizer itself does all others whole, and those that may hold a special token. Words of more than
    ``LONGEST`` bytes aren't kept, so the number of words bounds the memory.
    """

    LONGEST = 64

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            pieces = CUT.findall(text.lower())
            if pieces == [text]:
                found = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(BYTE_LETTERS))]
                ids = struct.pack(f"<{len(found)}I", *found)
            else:
                ids = b"".join([self[p.encode()] for p in pieces])
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= self.LONGEST:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str, most: int = CACHE_WORDS) -> WordIds:
    """One cache for each vocabulary file and Python worker."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    _WORD_IDS[path].most = most
    return _WORD_IDS[path]


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Tokenize each text, append ``end_id`` and cut the ids at every ``capacity`` of them.

    Null and empty texts are the end id alone. Rows are documents: repeated rows give repeated pieces.
    Returns doc_id, start, length, ids_crc32, doc_tokens. ``cache_words`` bounds a worker's tokenizer cache.
    """
    prepare(docs.sparkSession)
    end, step = np.uint32(end_id).astype("<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(tokenizer, cache_words)
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for key, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = cache.of(x or "") + end
                n = len(ids) // 4
                rows += [(key, at // 4, len(part := ids[at : at + step]) // 4, zlib.crc32(part), n) for at in range(0, len(ids), step)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048, group: int = 16384, seed: int = 17) -> DataFrame:
    """Put pieces (``length`` of 1 to ``capacity``) into sequences of at most ``capacity``.

    Adds sequence_id and offset. A sequence id is the partition's number in the high bits and a counter below.
    Ties are broken by the piece's position in its group, which the sort fixes; equal rows are interchangeable.
    An empty input gives no rows.
    """
    prepare(pieces.sparkSession)
    names = pieces.columns
    dealt = (
        pieces.withColumn("_deal", F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"))
        .repartition("_deal")
        .sortWithinPartitions("_deal", "doc_id", "start", "ids_crc32", "length")
        .drop("_deal")
    )
    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
            while rows >= group or (batch is None and rows):
                table = pa.Table.from_batches(held)
                now = table.slice(0, group)
                rest = table.slice(group)
                held, rows = rest.to_batches(), rest.num_rows
                bins, offsets = best_first_fit(now.column("length").to_numpy(), capacity)
                now = now.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
                base += int(bins.max()) + 1
                yield from now.select([*names, "sequence_id", "offset"]).combine_chunks().to_batches()

    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group: int = 16384, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Tokenize, cut and pack; see cut() and pack() for the edge cases.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; other columns of ``docs`` are ignored.
    """
    return pack(cut(docs, tokenizer, capacity, end_id, cache_words=cache_words), capacity, group)
