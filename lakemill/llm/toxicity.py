"""Toxicity scoring with a factorization machine over hashed terms.

A text is the set of its hashed terms: lower-cased runs of letters, and their first four to seven letters as
terms of their own, so that inflected and compounded forms share evidence. The machine is
``w0 + sum(w_i) + sum over pairs(<v_i, v_j>)``: the pair part learns that two terms together (an insult and a
group mention) mean more than each alone, which additive weights can't express.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import durable, forget, prepare, slices

#: Hash cells of terms.
CELLS = 1 << 18
PREFIXES = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
#: Words kept by a worker's cache before it starts again.
CACHE_WORDS = 300_000
BLOCK = 256


class TermCells(dict):
    """The hash cells of a word's terms."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        terms = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
        self[word] = out = tuple(zlib.crc32(t.encode("utf-8", "ignore")) % CELLS for t in terms)
        return out


_CELLS = TermCells()


def cells_of(text: str) -> set[int]:
    return set().union(*map(_CELLS.__getitem__, set(WORD.findall(text.lower()))))


@dataclass
class FactorizationMachine:
    features: np.ndarray  # the hash cells that are features
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """x: 0/1 rows. With such rows x squared is x, which the pair part uses."""
        s = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * ((s * s).sum(1) - x @ (self.factors * self.factors).sum(1))

    def place(self) -> np.ndarray:
        return place_of(self.features)


def place_of(features: np.ndarray) -> np.ndarray:
    """The feature of each hash cell, or the number of features where it has none."""
    at = np.full(CELLS, len(features), "i4")
    at[features] = np.arange(len(features), dtype="i4")
    return at


def rows_of(sets: list[np.ndarray], place: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((len(sets), n + 1), "f4")
    for i, s in enumerate(sets):
        x[i, place[s]] = 1
    return x[:, :n]


def separation(pos, neg, n1: int, n0: int):
    """By how many standard errors a cell's frequencies in the two classes differ. Numbers, arrays or Spark columns."""
    p = (pos + neg + 1) / (n1 + n0 + 2)
    return (pos / n1 - neg / n0) / (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5


def fit(features: np.ndarray, x: np.ndarray, labels: np.ndarray, weights: np.ndarray, rank: int = 8, epochs: int = 30, seed: int = 7) -> FactorizationMachine:
    """Logistic loss by Adam over mini-batches.

    ``features``: hash cells; ``x``: 0/1 rows of which cells a text has; ``weights``: each row's weight. With one class,
    no rows or no features the machine is a constant.
    """
    total = float(weights.sum()) or 1.0
    rate = float(np.clip((weights * labels).sum() / total, 1e-3, 1 - 1e-3))
    constant = FactorizationMachine(np.zeros(0, "i8"), float(np.log(rate / (1 - rate))), np.zeros(0, "f4"), np.zeros((0, rank), "f4"))
    if not len(features) or not labels.any() or labels.all():
        return constant
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(features, constant.bias, np.zeros(len(features), "f4"), rng.normal(0, 0.01, (len(features), rank)).astype("f4"))
    x, y, w = x.astype("f4"), labels.astype("f4"), (weights / total * len(labels)).astype("f4")
    state = [np.zeros_like(a) for a in (m.linear, m.factors) for _ in range(2)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BLOCK):
            b = order[i : i + BLOCK]
            xb = x[b]
            s = xb @ m.factors
            raw = m.bias + xb @ m.linear + 0.5 * ((s * s).sum(1) - xb @ (m.factors * m.factors).sum(1))
            g = w[b] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[b]) / len(b)
            step += 1
            m.bias -= 0.05 * float(g.sum())
            grads = (xb.T @ g + 1e-5 * m.linear, xb.T @ (g[:, None] * s) - (xb.T @ g)[:, None] * m.factors + 1e-4 * m.factors)
            for k, (a, d) in enumerate(zip((m.linear, m.factors), grads, strict=True)):
                m1, m2 = state[2 * k], state[2 * k + 1]
                m1 *= 0.9
                m1 += 0.1 * d
                m2 *= 0.999
                m2 += 0.001 * d * d
                a -= 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return m


def sample_of(labelled: DataFrame, label: str, most: int) -> tuple[DataFrame, dict[int, float], dict[int, int]]:
    """Rows of (doc_id, label), about half of each class and ``most`` in all by a hash of doc_id; the share drawn of
    each class, and its rows."""
    counts = {r[label]: r["count"] for r in labelled.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    share = {k: min(1.0, most / 2 / n) for k, n in counts.items()}
    draw = (F.xxhash64(F.lit(31), F.col("doc_id")) / F.lit(2.0**64)) + 0.5
    wanted = F.lit(False)
    for k, s in share.items():
        wanted = wanted | ((F.col(label) == k) & (draw < s))
    return labelled.where(wanted), share, counts


def features_of(cells: DataFrame, n1: int, n0: int, most: int) -> np.ndarray:
    """The ``most`` cells that tell the classes best apart, by more than three standard errors and with four texts at
    least. ``cells``: label, cells (the cells of a text). Texts of a cell are counted by Spark; ``most`` rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, "<u4") for x in batch.column("cells").to_pylist()]
            label = np.repeat(batch.column("label").to_numpy(), [len(x) for x in own])
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, "u4"), *own]).astype("i4")), pa.array(label)], names=["cell", "label"])

    counts = cells.select("cells", "label").mapInArrow(run, "cell int, label int").groupBy("cell").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    z = F.abs(separation(F.col("pos"), F.col("neg"), n1, n0))
    best = counts.where("pos + neg >= 4").select("cell", z.alias("z")).where("z > 3").orderBy(F.desc("z"), "cell").limit(most)
    return np.sort(np.array([r["cell"] for r in best.collect()], "i8"))


def train(docs: DataFrame, labelled: DataFrame, label: str = "toxic", most: int = 12_000, n_features: int = 1024) -> FactorizationMachine:
    """Fit on a bounded sample: at most about ``most`` rows of ``labelled`` (doc_id, ``label`` 0 or 1), by a hash of doc_id.

    Rows with another or null label are no examples. The sample's cells are written to the shared folder once. Only its
    ids, what tells the classes apart and a bit for each text and feature come to the driver, however long the texts.
    """
    prepare(docs.sparkSession)
    picked, share, counts = sample_of(labelled, label, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [np.array(sorted(cells_of(x or "")), "<u4").tobytes() for x in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array(sets, pa.binary())], names=["doc_id", "label", "cells"])

    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked.select("doc_id", F.col(label).cast("int").alias("label"))), "doc_id")
    cells = durable(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(run, "doc_id long, label int, cells binary"), "cells")
    n = {r["label"]: r["count"] for r in cells.groupBy("label").count().collect()}
    features = features_of(cells, n[1], n[0], n_features) if len(n) == 2 else np.zeros(0, "i8")
    place = place_of(features)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of([np.frombuffer(x, "<u4") for x in batch.column("cells").to_pylist()], place, len(features))
            packed = [r.tobytes() for r in np.packbits(rows.astype("u1"), axis=1)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], names=["doc_id", "label", "bits"])

    rows = sorted(cells.mapInArrow(bits, "doc_id long, label int, bits binary").collect(), key=lambda r: (r["doc_id"], r["label"], bytes(r["bits"])))
    forget(cells)
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), "u1").reshape(len(rows), -1) if len(features) else np.zeros((len(rows), 0), "u1")
    labels = np.array([r["label"] for r in rows], "i4")
    # Halfway between the classes as they are and classes of equal weight, whatever was drawn of each.
    weights = np.array([counts[r["label"]] ** -0.5 / share[r["label"]] for r in rows])
    return fit(features, np.unpackbits(packed, axis=1, count=len(features)) if len(features) else packed, labels, weights)


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add score (0..1) and predicted (score >= threshold) to every row, from the whole text alone.

    A null text is an empty one; a text without known terms gets the machine's bias. Existing columns of the
    two names are replaced; all others stay.
    """
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n = model.place(), len(model.features)
        for batch in slices(batches, text):
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                sets = [np.fromiter(cells_of(x or ""), "i8") for x in part.column(text).to_pylist()]
                raw = model.raw(rows_of(sets, place, n)).astype("f8")
                value = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
                yield pa.record_batch([*part.columns, pa.array(value), pa.array((value >= threshold).astype("i4"))], names=[*kept, "score", "predicted"])

    return docs.select(*kept).mapInArrow(run, schema)
