"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases by deterministic coin tossing, the phrases are named by a hash of their
content, and the names are parsed again, level by level. Where a phrase begins depends on a few symbols around
it and on nothing else, so a substring has the same phrases inside wherever it stands, whatever its offset.
The fingerprint is a bottom-k sketch of the names of all levels; likeness of two fingerprints estimates the
share of phrases that their texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import durable, partitions, prepare, slices

#: Levels, all of which enter the sketch at every length of text, so that the sketches of any two texts compare the
#: same kinds of phrases: of about 6, 15, 37 and 90 bytes. A level more would be a hundredth of a long text's names, and
#: of a short text's a single one that any edit changes.
LEVELS = 4
#: Names in a sketch, four bytes each.
SKETCH = 64
U = np.uint64
M1, M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * M1
    h = (h ^ (h >> U(27))) * M2
    return h ^ (h >> U(31))


def _low_bit(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit; x is never 0."""
    return np.bitwise_count((x & (~x + x.dtype.type(1))) - x.dtype.type(1))


def tossed(symbols: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels below 8 of which no two neighbours within a text are equal. Neighbouring symbols must differ.

    One toss replaces a symbol by twice the place of the lowest bit in which it differs from its left neighbour,
    plus that bit: 64-bit symbols become less than 128, then 14, then 8. A text's first symbol has no left
    neighbour and takes its own low bit.
    """
    at = symbols
    for _ in range(4 if symbols.dtype.itemsize > 1 else 3):
        left = np.empty_like(at)
        left[1:] = at[:-1]
        left[:1] = at[:1]
        left = np.where(head, at ^ at.dtype.type(1), left)
        place = _low_bit(at ^ left)
        at = (2 * place + ((at >> place.astype(at.dtype)) & at.dtype.type(1)).astype("u1")).astype("u1")
    return at


def phrases(symbols: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Where phrases begin: at each text's first symbol and at each local maximum of the labels.

    Labels are below 8 and neighbours differ, so a phrase has two symbols at least (but at a text's ends) and
    a bounded number at most. Runs of one symbol must have been made one symbol first.
    """
    if not len(symbols):
        return head
    label = tossed(symbols, head).astype("i1")
    left = np.concatenate([label[:1], label[:-1]])
    right = np.concatenate([label[1:], np.zeros(1, "i1")])
    right_head = np.concatenate([head[1:], np.ones(1, bool)])
    left_head = np.concatenate([np.zeros(1, bool), head[:-1]])
    # A maximum next to a text's first symbol would leave that alone as a phrase.
    return head | ((label > left) & ((label > right) | right_head) & ~left_head)


def _runs(symbols: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one symbol within a text as one: (begins, symbols, heads), a run of two or more named by symbol and length."""
    start = head.copy()
    start[1:] |= symbols[1:] != symbols[:-1]
    begins = np.flatnonzero(start)
    return begins, symbols[begins], head[begins]


def parse(raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the names of its phrases, and the text each belongs to."""
    symbols = np.frombuffer(b"".join(raw), "u1")
    sizes = np.array([len(x) for x in raw], "i8")
    text = np.repeat(np.arange(len(raw), dtype="i4"), sizes)
    head = np.ones(len(symbols), bool)
    head[1:] = text[1:] != text[:-1]
    out = []
    for level in range(LEVELS):
        begins, symbol, heads = _runs(symbols, head)
        lengths = np.diff(np.append(begins, len(symbols)))
        names = _mix(symbol.astype("u8") + U((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        names[lengths > 1] = _mix(names[lengths > 1] + lengths[lengths > 1].astype("u8"))
        # A run's symbol differs from its neighbours', and that is what coin tossing needs.
        start = phrases(symbol, heads)
        at = np.flatnonzero(start)
        place = np.arange(len(names)) - at[np.cumsum(start) - 1] if len(at) else np.zeros(0, "i8")
        weighed = _mix(names + place.astype("u8") * M2)
        symbols = _mix(np.add.reduceat(weighed, at)) if len(at) else np.zeros(0, "u8")
        text = text[begins][at] if len(at) else text[:0]
        head = heads[at] if len(at) else np.zeros(0, bool)
        out.append((symbols, text))
    return out


def sketches(texts: list[str]) -> np.ndarray:
    """A row of ``SKETCH`` 32-bit values for each text: the least of its names, in order; short texts are padded with the largest value.

    An empty text has only padding.
    """
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    levels = parse(raw)
    names = np.concatenate([n for n, _ in levels]) >> U(32)
    text = np.concatenate([t for _, t in levels]).astype("u8")
    both = np.sort((text << U(32)) | names)
    fresh = np.ones(len(both), bool)
    fresh[1:] = both[1:] != both[:-1]
    both = both[fresh]
    row = (both >> U(32)).astype("i8")
    place = np.arange(len(both)) - np.searchsorted(row, row)
    least = place < SKETCH
    out = np.full((len(raw), SKETCH), 0xFFFFFFFF, "u4")
    out[row[least], place[least]] = both[least].astype("u4")
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of the phrase sets, row by row: of the least ``SKETCH`` names of both, the share that both have.

    Two empty texts are alike (1); an empty one and another are not (0).
    """
    both = np.sort(np.hstack([a, b]), axis=1)
    full = np.uint32(0xFFFFFFFF)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != full)
    distinct = np.ones(both.shape, bool)
    distinct[:, 1:] = both[:, 1:] != both[:, :-1]
    distinct &= both != full
    in_union = (np.cumsum(distinct, 1) <= SKETCH) & distinct
    shared = (twice & in_union[:, :-1]).sum(1)
    total = in_union.sum(1)
    return np.where(total > 0, shared / np.maximum(total, 1), 1.0)


FINGERPRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in FINGERPRINTED.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Texts in one parse, by their characters.
PARSED = 1 << 20


def _rows(group: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """Results for all of ``group`` but the last, each with the one after it."""
    texts = [x for _, x in group]
    edited = []
    for x, following in zip(texts, texts[1:], strict=False):
        k = len(x) // 4
        edited.append(x[: len(x) - k] + following[:k])
    sketch = sketches(texts + edited)
    n = len(edited)
    own, following, changed = sketch[:n], sketch[1 : n + 1], sketch[len(texts) :]
    names = [[s.astype(">u4").tobytes().hex() for s in x] for x in (own, changed)]
    return pa.record_batch(
        [
            pa.array([i for i, _ in group[:n]], pa.int64()),
            pa.array([len(x) for x in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string()),
            pa.array(names[0], pa.string()),
            pa.array(names[1], pa.string()),
            pa.array(likeness(own, changed), pa.float64()),
            pa.array(likeness(own, following), pa.float64()),
        ],
        names=_NAMES,
    )


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and its likeness to the next document.

    Edited: the last quarter of the code points (rounded down) replaced by the first as many of the next document
    by id, the first document being next to the last; one document alone is its own next. Documents of one id
    follow each other in order of a hash of their text (then of the text), null ids come first, null texts are empty. Equal texts have equal
    fingerprints; a text without names (empty) has a fingerprint of padding only, like all other such.

    One range shuffle puts the documents in order, those of one id (null ids, say) in as many parts as any. Each part does its own pairs and hands on its first and last
    document, of which the second step makes the pairs across parts: two rows a part, whatever the input.
    """
    edges = "part int, edge string, edge_id long, edge_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: list[tuple[int | None, str]] = []
        total, first = 0, True

        def padded(batch: pa.RecordBatch) -> pa.RecordBatch:
            blank = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.string(), pa.int64(), pa.string())]
            return pa.record_batch([*batch.columns, *blank], names=names)

        def edge(kind: str, row: tuple[int | None, str]) -> pa.RecordBatch:
            own = [pa.array([v], t) for v, t in zip((number, kind, *row), (pa.int32(), pa.string(), pa.int64(), pa.string()), strict=True)]
            return pa.record_batch([*(pa.nulls(1, t) for t in _TYPES), *own], names=names)

        names = _NAMES + [f.split()[0] for f in edges.split(", ")]
        for part in slices(batches, "text", PARSED):
            for row in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if first:
                    yield edge("first", row)
                    first = False
                held.append(row)
                total += len(row[1])
                if total >= PARSED and len(held) > 1:
                    yield padded(_rows(held))
                    held, total = held[-1:], len(row[1])
        if len(held) > 1:
            yield padded(_rows(held))
        if held:
            yield edge("last", held[-1])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _rows([(i, x), (None, y)])

    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = rows.withColumn("_hash", F.xxhash64("text")).repartitionByRange(partitions(spark), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").drop("_hash")
    found = durable(ordered.mapInArrow(run, f"{FINGERPRINTED}, {edges}"), "fingerprints")
    last, first = (found.where(F.col("edge") == k) for k in ("last", "first"))
    parts = sorted(r["part"] for r in last.select("part").collect())  # one number a part
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, following int")
    pairs = last.join(following, "part").join(first.select(F.col("part").alias("following"), F.col("edge_text").alias("next_text")), "following")
    crossed = pairs.select("edge_id", "edge_text", "next_text").mapInArrow(across, FINGERPRINTED)
    return found.where("edge IS NULL").select(_NAMES).unionByName(crossed)
