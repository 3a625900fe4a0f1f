"""SimHash near-duplicate detection by a popcount embedding.

A 64-bit fingerprint is cut into 16 segments of four bits and mapped to the vector of their bit counts. Flipping
one bit moves the vector by one along one axis, so the Manhattan distance of two vectors never exceeds the
Hamming distance of the fingerprints. Fingerprints within two bits therefore lie within Manhattan distance
two, and a grid range-join finds those: each vector is put in its own cell and in the 32 cells one step away,
and two vectors within distance two always meet in one of them. What meets is verified exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import durable, forget, prepare, slices
from lakemill.llm.components import components

SEED = 42
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Hashes that one step of a fingerprint's count takes.
PART = 1 << 18
BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1).astype("f8")
#: Distinct fingerprints of one cell up to which all are compared with each other; larger cells use neighbours().
ALL_PAIRS = 64


def word_lists(data: bytes, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, of about ``most`` bytes of it at a time; one word may be longer."""
    at = 0
    while at < len(data):
        end = SPACE.search(data, at + most)
        yield data[at : end.start() if end else len(data)].split()
        at = end.start() if end else len(data)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Big-endian XXH64 of each run of ``shingle`` words, or of all words where there are fewer; as rows of 8 bytes."""
    digest, out, held = xxhash.xxh64_digest, [], []
    whole = True  # nothing is hashed yet
    for more in word_lists(text.encode("utf-8", "surrogatepass").lower()):
        words = held + more
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
            n = len(words) - shingle + 1
            starts = np.concatenate([[0], ends[: n - 1]])
            out.append(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[-n:] - 1).tolist(), strict=True)]))
            whole = False
        held = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if whole and held:
        out.append(digest(b" ".join(held), SEED))
    return np.frombuffer(b"".join(out), "u1").reshape(-1, 8)


def fingerprint(hashes: np.ndarray) -> bytes:
    """Eight bytes, big-endian: each bit is 1 if it is set in over half the hashes; zero for none."""
    if not len(hashes):
        return bytes(8)
    places = np.arange(0, 2048, 256, dtype="i8")
    counts = sum(np.bincount((hashes[i : i + PART] + places).ravel(), minlength=2048) for i in range(0, len(hashes), PART)).reshape(8, 256) @ BITS
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def with_fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """Add fp (the fingerprint as a signed long) to every row. Null and empty texts, and those of white space, get 0.

    A column named fp is replaced; all others stay.
    """
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            fps = b"".join(fingerprint(shingle_hashes(x or "", shingle)) for x in part.column(text).to_pylist())
            yield pa.record_batch([*part.columns, pa.array(np.frombuffer(fps, ">i8").astype("i8"))], names=[*kept, "fp"])

    return docs.select(*kept).mapInArrow(run, docs.select(*kept).schema.add("fp", "long"))


def neighbours(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what distances of two or fewer bits connect, a number linear in ``fps``.

    Each fingerprint is listed under itself and its 64 one-bit neighbours. All that are listed under one value
    are within two bits of each other, and any two within two bits share a value: linking each to the first is enough.
    """
    masks = np.concatenate([np.zeros(1, "u8"), np.uint64(1) << np.arange(64, dtype="u8")])
    keys = (fps.view("u8")[:, None] ^ masks).ravel()
    owner = np.repeat(np.arange(len(fps)), 65)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    head = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = owner[np.flatnonzero(head)[np.cumsum(head) - 1]]
    a, b = fps[first], fps[owner]
    return a[a != b], b[a != b]


def linked_in_cells(cells: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each cell; equal cells are adjacent. Small cells compare all their fingerprints."""
    head = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.concatenate([head, [len(cells)]]))
    left = np.repeat(sizes, sizes) - (np.arange(len(cells)) - np.repeat(head, sizes))  # rows from here to the cell's end
    small = np.repeat(sizes <= ALL_PAIRS, sizes)
    out_a, out_b = [], []
    for step in range(1, min(int(sizes.max(initial=1)), ALL_PAIRS)):
        i = np.flatnonzero(small & (left > step))
        near = np.bitwise_count(fps[i].view("u8") ^ fps[i + step].view("u8")) <= distance
        out_a.append(fps[i[near]])
        out_b.append(fps[i[near] + step])
    for at, n in zip(head[sizes > ALL_PAIRS].tolist(), sizes[sizes > ALL_PAIRS].tolist(), strict=True):
        group = np.unique(fps[at : at + n])
        a, b = neighbours(group)
        out_a.append(a)
        out_b.append(b)
    return np.concatenate([np.zeros(0, "i8"), *out_a]), np.concatenate([np.zeros(0, "i8"), *out_b])


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose transitive closure joins all within two bits.

    The 16 counts are the digits of a base-5 number, so a step along an axis adds or takes a power of five.
    Rows of a cell come together by a sort that can spill; a task holds one Arrow batch and the cell it ends in.
    """
    prepare(fps.sparkSession)
    digits = [f"bit_count(shiftrightunsigned(fp, {4 * i}) & 15L)" for i in range(16)]
    cell = " + ".join(f"{d} * {5**i}L" for i, d in enumerate(digits))
    steps = ", ".join(["0L", *(f"{s}{5**i}L" for i in range(16) for s in ("", "-"))])
    dealt = fps.selectExpr("fp", f"{cell} AS own").selectExpr("fp", f"explode(transform(array({steps}), d -> own + d)) AS cell").repartition("cell").sortWithinPartitions("cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cells, held_fps = np.zeros(0, "i8"), np.zeros(0, "i8")

        def links(cells: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            a, b = linked_in_cells(cells, values, 2)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.concatenate([held_cells, batch.column("cell").to_numpy()])
            values = np.concatenate([held_fps, batch.column("fp").to_numpy()])
            whole = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on in the next batch
            if whole:
                yield links(cells[:whole], values[:whole])
            held_cells, held_fps = cells[whole:], values[whole:]
        if len(held_cells):
            yield links(held_cells, held_fps)

    return dealt.select("cell", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: fingerprints link at two or fewer differing bits.

    component_id is the smallest doc_id reachable over links, itself included. Equal texts share a fingerprint
    and are one vertex, so a group of copies costs one row beyond its own. Texts without words have fingerprint
    0 and link like any other. A row with a null doc_id takes part, but names no component unless it is alone.
    """
    rows = durable(with_fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), shingle).select("doc_id", "fp"), "fingerprints")
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = durable(near_links(distinct.select("fp")), "links")
    roots = components(links)
    forget(links)
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = durable(classes.join(smallest, "root").select("fp", "component_id"), "named")
    forget(distinct)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
