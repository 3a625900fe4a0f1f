"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes around it also starts earlier. Suffixes of the whole corpus don't fit
one array, so they are dealt by content: of the k-grams in a window of ``length`` bytes, the one with the least
hash is the window's anchor, and equal windows have equal anchors at the same place. Windows in a row with the
same anchor form a run. The stages:

1. Texts are gathered in blocks and written to the shared folder.
2. Each block sends the hashes and places of its distinct runs to buckets by anchor. A bucket sees each run once a
   block, however many copies there are, and answers for each: it is the later copy of a run, and where the first
   one is; or it is the first of several different runs around one anchor, so some of its windows may repeat.
3. Later copies in a row of first copies in a row make a span. Each block sends the bytes of its spans to the blocks
   that hold the first copies, where the bytes are compared: all windows of an equal span repeat.
4. Runs of the second kind send their bytes to where the runs with the same core (the bytes common to all the
   run's windows) meet. There a suffix array, cut off at ``length`` symbols, brings equal windows together, and
   the previous and next smaller positions in suffix order tell which have an earlier match.
5. Each block drops the bytes so covered.

Hashes only decide who meets; bytes decide what is equal. Different runs of one hash, of which no case is known, end
the job with an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
import pyspark.sql.types as T
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import durable, partitions, prepare, slices

#: Bytes of text in a block; compressed, a block stays below what the JVM's collector treats as a humongous object.
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 60_000
#: Bytes of a block whose windows are hashed at a time. Only a text that is longer has more.
PART = 4 << 20
#: Symbols that one suffix array holds, unless a single core has more.
ARRAY_SYMBOLS = 1 << 20
#: Runs of one core beyond which its windows meet one by one, by a hash aggregation, instead of in one task.
MOST_OF_CORE = 4096
NULL_ID = -(2**63)

BLOCKS = "block long, ids binary, sizes binary, text binary, rest binary"
#: Bytes of compressed blocks for each bucket: it then gets about as many bytes of requests, which a task holds at a time.
BUCKET_BYTES = 16 << 20
REQUESTS = "bucket int, block long, docs binary, runs binary, places binary"
REPLIES = "bucket int, block long, codes binary, firsts binary"
FOUND = "block long, spans binary, core long, doc_id long, doc int, at int, bytes binary, source long"
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
U = np.uint64


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, n or more."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        _POWERS[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size, U(m))])) for m in (MULTIPLIER, pow(MULTIPLIER, -1, 2**64))]
    return _POWERS


def _mix(h: np.ndarray, m: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(m)
    return h ^ (h >> U(32))


class Runs:
    """The runs of a block: anchor p, first and last window a and b, in bytes of the block; document; hashes."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int):
        self.data, self.length = data, length
        self.doc_starts = np.cumsum(sizes) - sizes
        found = [self._part(at, sizes) for at in range(0, max(len(data) - length + 1, 1), PART)]
        self.p, self.a, self.b, self.doc, self.anchor, self.run = (np.concatenate(x) for x in zip(*found, strict=True))

    def _part(self, at: int, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """The runs of the windows that begin in the ``PART`` bytes from ``at``, so that a very long text doesn't need
        all of its hashes at once. A run that goes on in the next part is two runs."""
        length, k = self.length, self.length // 2
        data = self.data[at : at + PART + length - 1]
        n = len(data)
        if n < length:
            return (np.zeros(0, "i8"),) * 4 + (np.zeros(0, "u8"),) * 2
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, "u8")
        terms = data.astype("u8")
        terms += U(1)
        terms *= down[:n]
        np.cumsum(terms, out=sums[1:])
        del terms
        first = int(np.searchsorted(self.doc_starts, at, "right")) - 1
        last = int(np.searchsorted(self.doc_starts, at + n, "left"))
        ends = np.minimum(self.doc_starts[first:last] + sizes[first:last], at + n)
        doc = np.repeat(np.arange(first, last, dtype="i4"), np.maximum(ends - np.maximum(self.doc_starts[first:last], at), 0))
        h = sums[k:] - sums[:-k]
        h *= up[: n - k + 1]
        h = _mix(h)
        # Order by the hash's high half; of equal ones the leftmost. Both ends of an equal window choose alike.
        least = h & U(0xFFFFFFFF00000000)
        least |= np.arange(len(h), dtype="u8")
        width, step = length - k + 1, 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: step - width], least[width - step :])
        start = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
        at_p, at_doc = (least[start] & U(0xFFFFFFFF)).astype("i8"), doc[start]
        del least, doc
        head = np.ones(len(start), bool)
        head[1:] = (at_p[1:] != at_p[:-1]) | (at_doc[1:] != at_doc[:-1])
        tail = np.concatenate([head[1:], np.ones(1, bool)]) if len(head) else head
        p, a, b = at_p[head], start[head], start[tail]
        # The chosen hashes are small ones; mixed again they are spread evenly.
        run = _mix((sums[b + length] - sums[a]) * up[a])
        return p + at, a + at, b + at, at_doc[head].astype("i8"), _mix(h[p], 0x94D049BB133111EB), run

    def hash(self, start: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the ``size`` bytes from each start, a few at a time."""
        up, down = _powers(size + 1)
        out = np.zeros(len(start), "u8")
        for i in range(0, len(start), 4096):
            piece = self.data[start[i : i + 4096, None] + np.arange(size)].astype("u8")
            out[i : i + 4096] = ((piece + U(1)) * down[:size]).sum(1, dtype="u8")
        return out

    def sent(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, bounds, first): the distinct runs by bucket and then place in the block; where each bucket
        begins in them; for each run the place of the first equal run of the block."""
        by = np.lexsort((self.run, self.anchor))
        anchor, run = self.anchor[by], self.run[by]
        head = np.ones(len(by), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])
        first = np.empty(len(by), "i8")
        first[by] = by[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(by) else by
        own = np.flatnonzero(first == np.arange(len(first)))
        bucket = ((self.anchor[own] >> U(40)) * U(buckets) >> U(24)).astype("i8")
        order = own[np.argsort(bucket, kind="stable")]
        return order, np.searchsorted(np.sort(bucket), np.arange(buckets + 1)), first


def _five(x: np.ndarray) -> np.ndarray:
    """The low five bytes of each."""
    return x.astype("<u8").view("u1").reshape(-1, 8)[:, :5]


def _wide(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), "u1")
    out[:, :5] = x
    return out.view("<u8").ravel()


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x.tobytes())


def _unzip(x: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype)


def make_blocks(docs: DataFrame, doc_id: str, text: str, carry: list[str]) -> DataFrame:
    """Blocks of whole documents in order of their id. Null texts are empty; null ids count as the smallest.
    ``carry``: columns whose values go along untouched, as an Arrow stream, under numbers for their names."""
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, bytes]] = []
        rest: list[pa.RecordBatch] = []
        total = 0

        def block() -> pa.RecordBatch:
            order = sorted(range(len(held)), key=lambda i: held[i])
            raw = [held[i][1] for i in order]
            other = b""
            if carry:
                sink = pa.BufferOutputStream()
                table = pa.Table.from_batches(rest).take(order)
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                other = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            row = [[number], [_zip(np.array([held[i][0] for i in order], "i8"))], [_zip(np.array([len(x) for x in raw], "i8"))], [zstandard.ZstdCompressor(level=3).compress(b"".join(raw))], [other]]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, [pa.int64()] + [pa.binary()] * 4, strict=True)], names=["block", "ids", "sizes", "text", "rest"])

        for part in slices(batches, "_text"):
            begin = 0
            for k, (i, x) in enumerate(zip(part.column("_id").to_pylist(), part.column("_text").to_pylist(), strict=True)):
                raw = (x or "").encode("utf-8", "surrogatepass")
                if held and (total + len(raw) > BLOCK_BYTES or len(held) >= BLOCK_ROWS):
                    rest.append(part.select(names).slice(begin, k - begin))
                    yield block()
                    number, held, rest, total, begin = number + 1, [], [], 0, k
                held.append((NULL_ID if i is None else i, raw))
                total += len(raw)
            rest.append(part.select(names).slice(begin))
        if held:
            yield block()

    own = [F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")]
    return docs.select(*own, *(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True))).mapInArrow(run, BLOCKS)


def _opened(row: dict, length: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Runs | None]:
    ids, sizes = _unzip(row["ids"], "i8"), _unzip(row["sizes"], "i8")
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=int(sizes.sum()) + 1), "u1")
    return ids, sizes, data, Runs(data, sizes, length) if length else None


def _binary(*columns: tuple[list, pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in columns], names=names)


def requests(blocks: DataFrame, buckets: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, _, runs = _opened(row, length)
                order, bounds, _ = runs.sent(buckets)
                pairs = np.hstack([_five(runs.anchor[order]), runs.run[order].astype("<u8").view("u1").reshape(-1, 8)])
                gaps = np.diff(ids, prepend=0)
                out = []
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    part = order[bounds[k] : bounds[k + 1]]
                    # Documents with runs there: which, their ids' gaps, and how many runs each has.
                    docs, counts = np.unique(runs.doc[part], return_counts=True)
                    told = np.concatenate([np.diff(ids[docs], prepend=0), counts])
                    out.append((k, row["block"], _zip(told), pairs[bounds[k] : bounds[k + 1]].tobytes(), _zip(np.diff(runs.a[part], prepend=0).astype("i4"))))
                b, at, docs, data, places = zip(*out, strict=True) if out else ((), (), (), (), ())
                yield _binary((b, pa.int32()), (at, pa.int64()), (docs, pa.binary()), (data, pa.binary()), (places, pa.binary()), names=["bucket", "block", "docs", "runs", "places"])

    return blocks.mapInArrow(run, REQUESTS)


def answer(rows: list[dict]) -> list[tuple[bytes, bytes]]:
    """For the rows of one bucket: (two bits a run, where the first copies are). 1: an equal run comes earlier; 2: it is
    the first of its kind but other kinds share its anchor; else 0. For each 1 the block and place of the first copy.
    Earlier: by document id, then block, then place."""
    runs = np.concatenate([np.frombuffer(r["runs"], "u1").reshape(-1, 13) for r in rows])
    sizes = [len(r["runs"]) // 13 for r in rows]
    block = np.repeat([r["block"] for r in rows], sizes)
    place = np.concatenate([np.cumsum(_unzip(r["places"], "i4"), dtype="i8") for r in rows])
    ids = []
    for r in rows:
        gaps, counts = np.split(_unzip(r["docs"], "i8"), 2)
        ids.append(np.repeat(np.cumsum(gaps), counts))
    order = np.lexsort((place, block, np.concatenate(ids)))
    anchor, run = _wide(runs[:, :5]), np.ascontiguousarray(runs[:, 5:]).view("<u8").ravel()
    order = order[np.lexsort((run[order], anchor[order]))]
    anchor, run = anchor[order], run[order]
    group = np.ones(len(order), bool)
    group[1:] = anchor[1:] != anchor[:-1]
    kind = group.copy()
    kind[1:] |= run[1:] != run[:-1]
    number = np.cumsum(group) - 1
    several = np.bincount(number, weights=kind)[number] > 1
    first = order[np.flatnonzero(kind)[np.cumsum(kind) - 1]]
    codes, firsts = np.zeros(len(order), "u1"), np.zeros(len(order), "i8")
    codes[order] = np.where(kind, np.where(several, 2, 0), 1)
    firsts[order] = first
    out, at = [], 0
    for n in sizes:
        own = codes[at : at + n]
        source = firsts[at : at + n][own == 1]
        out.append((_zip(own), _zip(np.concatenate([block[source], place[source]]))))
        at += n
    return out


def replies(asked: DataFrame, parts: int) -> DataFrame:
    """Answers for each bucket. Rows come by bucket, of which a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def told() -> pa.RecordBatch:
            codes, firsts = zip(*answer(held), strict=True)
            return _binary(([r["bucket"] for r in held], pa.int32()), ([r["block"] for r in held], pa.int64()), (codes, pa.binary()), (firsts, pa.binary()), names=["bucket", "block", "codes", "firsts"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                if held and row["bucket"] != held[0]["bucket"]:
                    yield told()
                    held = []
                held.append(row)
        if held:
            yield told()

    return asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, REPLIES)


def _joined(blocks: DataFrame, side: DataFrame, columns: list[str]) -> DataFrame:
    """Each block with all its rows of ``side`` as one array, empty where it has none."""
    grouped = side.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("found"))
    return blocks.select(*blocks.columns).join(grouped, "block", "left")


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Document in its block, start and end of pieces, those that touch or overlap as one. In order of place."""
    if len(doc):
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        # Ends grow with starts here, so a gap shows against the piece before.
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
        at = np.flatnonzero(head)
        doc, start, end = doc[at], start[at], np.maximum.reduceat(end, at)
    return _zip(np.stack([doc, start, end]).astype("i4"))


def _chained(a: np.ndarray, b: np.ndarray, doc: np.ndarray, block: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, source place) of the spans that runs make: runs a..b of one document, in order of place, whose first
    copies lie in one block at one distance from them, without a gap between."""
    head = np.ones(len(a), bool)
    shift = place - a
    head[1:] = (doc[1:] != doc[:-1]) | (block[1:] != block[:-1]) | (shift[1:] != shift[:-1]) | (a[1:] > b[:-1] + 1)
    at = np.flatnonzero(head)
    last = np.concatenate([at[1:], [len(a)]])[: len(at)] - 1
    return at, b[last], place[at]


def candidates(blocks: DataFrame, answered: DataFrame, buckets: int, length: int) -> DataFrame:
    """What the answers tell, rows of three kinds: spans of runs that repeat within the block (spans, a row a block);
    for each block of first copies the spans said to repeat it, with their bytes (source, spans, bytes); and runs to
    compare, by core.

    A run is cut where its windows begin within a quarter of ``length`` before the anchor or further off, so that
    each part has a core of three quarters of ``length`` at a fixed place from the anchor.
    """
    quarter, half = length // 4, length // 2
    names = [f.split()[0] for f in FOUND.split(", ")]

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        types = {"block": pa.int64(), "spans": pa.binary(), "core": pa.int64(), "doc_id": pa.int64(), "doc": pa.int32(), "at": pa.int32(), "bytes": pa.binary(), "source": pa.int64()}
        return pa.record_batch([columns.get(c, pa.nulls(n, types[c])) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, data, runs = _opened(row, length)
                order, bounds, first = runs.sent(buckets)
                codes = np.zeros(len(order), "u1")
                source, place = np.full(len(runs.p), row["block"]), runs.a[first]
                for x in row["found"] or []:
                    s = slice(bounds[x["bucket"]], bounds[x["bucket"] + 1])
                    codes[s] = _unzip(x["codes"], "u1")
                    mine = order[s][codes[s] == 1]
                    source[mine], place[mine] = np.split(_unzip(x["firsts"], "i8"), 2)
                code = np.zeros(len(runs.p), "u1")
                code[order] = codes
                code[first != np.arange(len(first))] = 1
                hit = np.flatnonzero(code == 1)
                at, last, begin = _chained(runs.a[hit], runs.b[hit], runs.doc[hit], source[hit], place[hit])
                doc, start, end, source = runs.doc[hit][at], runs.a[hit][at], last + length, source[hit][at]
                base, raw = runs.doc_starts[doc], data.tobytes()
                own = np.flatnonzero(source == row["block"])
                for s, e, w in zip(start[own].tolist(), end[own].tolist(), begin[own].tolist(), strict=True):
                    if raw[s:e] != raw[w : w + e - s]:
                        raise RuntimeError("two different runs have one hash")
                yield rows(1, block=pa.array([row["block"]]), spans=pa.array([_spans(doc[own], (start - base)[own], (end - base)[own])], pa.binary()))
                away = np.flatnonzero(source != row["block"])
                away = away[np.argsort(source[away], kind="stable")]
                for group in np.split(away, np.flatnonzero(np.diff(source[away])) + 1) if len(away) else []:
                    told = _zip(np.stack([doc[group], (start - base)[group], (end - base)[group], begin[group]]))
                    body = zstandard.ZstdCompressor(level=3).compress(b"".join(raw[s:e] for s, e in zip(start[group].tolist(), end[group].tolist(), strict=True)))
                    yield rows(1, block=pa.array([row["block"]]), spans=pa.array([told], pa.binary()), bytes=pa.array([body], pa.binary()), source=pa.array([int(source[group[0]])]))
                more = np.flatnonzero(code == 2)
                p, a, b, doc = runs.p[more], runs.a[more], runs.b[more], runs.doc[more]
                near, far = b > p - quarter - 1, a < p - quarter
                start = np.concatenate([np.maximum(a, p - quarter)[near], a[far]])
                end = np.concatenate([b[near], np.minimum(b, p - quarter - 1)[far]]) + length
                core = np.concatenate([_mix(runs.hash(p[near], length - quarter)), ~_mix(runs.hash(p[far] - quarter - 1, length - half + quarter + 1))])
                doc = np.concatenate([doc[near], doc[far]])
                for i in range(0, len(doc), 20_000):
                    s = slice(i, i + 20_000)
                    n = len(doc[s])
                    yield rows(
                        n, block=pa.array(np.full(n, row["block"])), core=pa.array(core[s].view("i8")), doc_id=pa.array(ids[doc[s]]), doc=pa.array(doc[s].astype("i4")),
                        at=pa.array((start[s] - runs.doc_starts[doc[s]]).astype("i4")), bytes=pa.array([raw[x:y] for x, y in zip(start[s].tolist(), end[s].tolist(), strict=True)], pa.binary()),
                    )

    return _joined(blocks, answered, ["bucket", "codes", "firsts"]).mapInArrow(run, FOUND)


def confirmed(blocks: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """(block, spans) of the rows (block, source, spans, bytes) of ``told`` once their bytes are found in block ``source``.

    A block comes before all that refers to it, so that a task holds one block and one row of spans at a time,
    however many blocks repeat what stands there.
    """
    texts = blocks.select(F.col("block").alias("source"), F.lit(None).cast("long").alias("block"), F.col("sizes").alias("spans"), F.col("text").alias("bytes"))
    dealt = texts.unionByName(told.select("source", "block", "spans", "bytes")).repartition(parts, "source").sortWithinPartitions("source", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = b""
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                block, spans, body = (batch.column(c)[i].as_py() for c in ("block", "spans", "bytes"))
                if block is None:
                    text = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(_unzip(spans, "i8").sum()) + 1)
                    continue
                doc, start, end, begin = _unzip(spans, "i8").reshape(4, -1)
                size = (end - start).tolist()
                if b"".join([text[w : w + n] for w, n in zip(begin.tolist(), size, strict=True)]) != zstandard.ZstdDecompressor().decompress(body, max_output_size=sum(size) + 1):
                    raise RuntimeError("two different runs have one hash")
                out.append((block, _spans(doc, start, end)))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["block", "spans"])

    return dealt.select("block", "spans", "bytes").mapInArrow(run, "block long, spans binary")


def suffix_order(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes by their first ``length`` symbols, each below 512, and the place in that order at
    which those with the same first symbols begin. Prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    wide = np.concatenate([symbols.astype("i8"), np.zeros(7, "i8")])
    known = min(7, length)
    key = np.zeros(n, "i8")
    for i in range(known):
        key = (key << 9) | wide[i : i + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, "i8")

    def ranked(at: np.ndarray, key: np.ndarray, places: np.ndarray) -> None:
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        rank[at] = places[np.flatnonzero(head)[np.cumsum(head) - 1]]

    ranked(order, key[order], np.arange(n))
    while known < length:
        step = min(known, length - known)
        r = rank[order]
        same = r[1:] == r[:-1]
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if not len(tied):
            break
        at = order[tied]
        beyond = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1) + 1
        key = (rank[at] << 32) | beyond
        by = np.argsort(key, kind="stable")
        order[tied] = at[by]
        ranked(at[by], key[by], tied)
        known += step
    return order, rank


def nearest_smaller(values: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Index of the previous smaller value within the group, or -1. head: where groups begin. Minima over 1, 2, 4, ...
    values back are tabled and then searched, from the widest."""
    n = len(values)
    begin = np.flatnonzero(head)[np.cumsum(head) - 1]
    longest = int((np.arange(n) - begin).max(initial=0)) + 1
    tables = [values]
    while 1 << len(tables) <= longest:
        t, w = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(t, np.concatenate([t[:w], t[:-w]])))
    at = np.arange(n) - 1  # all of those after it, up to the value's own place, aren't smaller
    for level in reversed(range(len(tables))):
        w = 1 << level
        fits = at - w + 1 >= begin
        skip = fits & (tables[level][np.maximum(at, 0)] >= values)
        at = np.where(skip, at - w, at)
    return np.where((at >= begin) & (values[np.maximum(at, 0)] < values), at, -1)


def has_earlier(symbols: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor of each position reaches ``length``; symbol 0 matches nothing.

    The longest match that starts earlier is with the previous or the next smaller position in suffix order. It
    reaches ``length`` where that one shares the rank of its first ``length`` symbols.
    """
    out = np.zeros(len(symbols), bool)
    if not len(symbols):
        return out
    order, rank = suffix_order(symbols, length)
    r = rank[order]
    same = r[1:] == r[:-1]
    tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    position, group = order[tied], r[tied]
    ends = np.concatenate([np.cumsum(symbols == 0), np.full(length, len(symbols))])
    whole = ends[position + length - 1] == ends[position] - (symbols[position] == 0)
    position, group = position[whole], group[whole]
    if not len(position):
        return out
    head = np.concatenate([[True], group[1:] != group[:-1]])
    previous = nearest_smaller(position, head)
    following = nearest_smaller(position[::-1], np.concatenate([head[1:], [True]])[::-1])[::-1]
    out[position[(previous >= 0) | (following >= 0)]] = True
    return out


def compare(runs: DataFrame, length: int) -> DataFrame:
    """Spans (block, spans) of the windows in ``runs`` that have an earlier equal window under the same core."""

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        raw = rows.column("bytes").to_pylist()
        sizes = np.fromiter(map(len, raw), "i8", len(raw)) + 1
        starts = np.cumsum(sizes) - sizes
        symbols = np.zeros(int(sizes.sum()), "u2")
        body = np.ones(len(symbols), bool)
        body[starts + sizes - 1] = False
        symbols[body] = np.frombuffer(b"".join(raw), "u1").astype("u2") + 1
        hit = np.flatnonzero(has_earlier(symbols, length))
        if not len(hit):
            return
        row = np.searchsorted(starts, hit, "right") - 1
        block, doc = rows.column("block").to_numpy()[row], rows.column("doc").to_numpy()[row]
        at = rows.column("at").to_numpy()[row] + hit - starts[row]
        order = np.argsort(block, kind="stable")
        block, doc, at = block[order], doc[order], at[order]
        heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        spans = [_spans(d, a, a + length) for d, a in zip(np.split(doc, heads[1:]), np.split(at, heads[1:]), strict=True)]
        yield pa.record_batch([pa.array(block[heads]), pa.array(spans, pa.binary())], names=["block", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            total += batch.column("bytes").nbytes
            if total < ARRAY_SYMBOLS:
                continue
            table = pa.Table.from_batches(held)
            core = table.column("core").to_numpy()
            whole = int(np.searchsorted(core, core[-1]))  # the last core may go on in the next batch
            yield from emit(_several(table.slice(0, whole)))
            held = table.slice(whole).combine_chunks().to_batches()
            total = sum(b.column("bytes").nbytes for b in held)
        if held:
            yield from emit(_several(pa.Table.from_batches(held)))

    dealt = runs.repartition("core").sortWithinPartitions("core", "doc_id", "block", "doc", "at")
    return dealt.mapInArrow(run, "block long, spans binary")


def _several(table: pa.Table) -> pa.Table:
    """Rows whose core another row has too."""
    core = table.column("core").to_numpy()
    same = core[1:] == core[:-1]
    return table.filter(pa.array(np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(core) else np.zeros(0, bool)))


def compare_windows(runs: DataFrame, length: int) -> DataFrame:
    """As compare(), for cores with so many different runs that one task shouldn't hold them: their windows, cut
    out one by one, meet in an aggregation that combines before it shuffles, and the first of each kind stays."""
    places = ["doc_id", "block", "doc", "at"]
    windows = runs.selectExpr(*places, f"explode(sequence(0, length(bytes) - {length})) AS i", "bytes").selectExpr("doc_id", "block", "doc", "at + i AS at", f"substring(bytes, i + 1, {length}) AS bytes")
    firsts = windows.groupBy("bytes").agg(F.min(F.struct(*places)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = windows.join(firsts, "bytes").where(F.struct(*places) != F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_zip(np.array([[d], [a], [a + length]], "i4")) for d, a in zip(batch.column("doc").to_pylist(), batch.column("at").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("block"), pa.array(spans, pa.binary())], names=["block", "spans"])

    return again.select("block", "doc", "at").mapInArrow(run, "block long, spans binary")


def removal(blocks: DataFrame, spans: DataFrame, carried: T.StructType | None) -> DataFrame:
    """The result rows; with ``carried``, the type of the columns that the blocks carry, those columns and the kept text."""
    results = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema: T.StructType | str = REMOVED
    if carried is not None:
        schema = T.StructType([*carried.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes, data, _ = _opened(row, None)
                starts = np.cumsum(sizes) - sizes
                change = np.zeros(len(data) + 1, "i4")
                for x in row["found"] or []:
                    doc, start, end = _unzip(x["spans"], "i4").reshape(3, -1).astype("i8")
                    np.add.at(change, starts[doc] + start, 1)
                    np.add.at(change, starts[doc] + end, -1)
                gone = np.cumsum(change[:-1], dtype="i4") > 0
                raw = data.tobytes()
                other = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all() if carried is not None else None
                for at in range(0, len(ids), 2000):
                    out = []
                    for i, s, n in zip(ids[at : at + 2000].tolist(), starts[at : at + 2000].tolist(), sizes[at : at + 2000].tolist(), strict=True):
                        cut = gone[s : s + n]
                        kept = data[s : s + n][~cut].tobytes() if cut.any() else raw[s : s + n]
                        if carried is not None:
                            out.append((kept.decode("utf-8", "ignore"), n - len(kept)))
                            continue
                        n_spans = int(n > 0 and cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1]))
                        out.append((i if i != NULL_ID else None, n, n - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
                    columns = list(zip(*out, strict=True))
                    if carried is None:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names=results)
                    else:
                        part = other.slice(at, 2000).combine_chunks()
                        arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
                        arrays = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in arrays]
                        yield pa.record_batch([*arrays, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=schema.names)

    return _joined(blocks, spans, ["spans"]).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", keep_columns: bool = False) -> DataFrame:
    """Drop each byte covered by a ``length``-byte string that also starts earlier in the corpus.

    Earlier: in a document of smaller id, or further left in the same one. Strings lie within one document and
    are judged on the input, overlaps included. Returns a row for each document: doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs) and kept_sha256; with ``keep_columns`` instead all columns of ``docs`` but
    ``text``, with kept_text and n_removed (replacing such columns): the bytes that stay as text, without those
    of a character that a cut has split. Null texts are empty; texts shorter than ``length`` keep all. Rows
    that share an id (null is one, smaller than all others) are ordered among themselves by where they are stored.
    """
    prepare(docs.sparkSession)
    carry = [c for c in docs.columns if c not in (text, "kept_text", "n_removed")] if keep_columns else []
    carried = docs.select(*carry).schema if keep_columns else None
    blocks = durable(make_blocks(docs, doc_id, text, carry), "blocks", "uncompressed")
    # A run takes about half as many bytes of requests as its own share of text.
    total = blocks.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = partitions(docs.sparkSession)
    buckets = max(parts, math.ceil(total / BUCKET_BYTES))
    answered = replies(requests(blocks, buckets, length), buckets)
    found = durable(candidates(blocks, answered, buckets, length), "candidates")
    runs = found.where("core IS NOT NULL").select("core", "doc_id", "block", "doc", "at", "bytes")
    crowded = durable(runs.groupBy("core").count().where(F.col("count") > MOST_OF_CORE).select("core"), "crowded")
    spans = found.where("core IS NULL AND source IS NULL").select("block", "spans")
    spans = spans.unionByName(confirmed(blocks, found.where("source IS NOT NULL"), buckets))
    spans = spans.unionByName(compare(runs.join(crowded, "core", "left_anti"), length))
    if not crowded.isEmpty():
        spans = spans.unionByName(compare_windows(runs.join(crowded, "core", "left_semi"), length))
    return removal(blocks, spans, carried)
