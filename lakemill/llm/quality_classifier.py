"""Quality scoring by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features; the chance that one is preferred to another is the
logistic function of the difference of their strengths. Preference pairs put a good document before a bad one;
logistic loss on feature differences learns the weights, over all pairs of labelled documents. The cut between good
and bad is a quantile of the strengths: the share of bad documents among the labelled ones.

A pair's loss depends on its two strengths only, so what all pairs say about a document follows from its strength and
the other class's distribution of strengths. Each step counts that distribution in one pass over the labelled rows and
sums gradient and curvature in a second; neither the rows nor the pairs come to the driver.
"""

from __future__ import annotations

import pickle
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import durable, forget, prepare, slices

KINDS = ("lower", "upper", "letter", "digit", "space", "newline", "symbol", "stop", "comma", "shout", "mark", "other")
#: Hash cells of words.
CELLS = 128
CACHE_WORDS = 300_000
BLOCK = 256
#: Nodes to a unit of strength where strengths are counted, and such nodes to one of the curvature's.
NODES, COARSE = 128, 64


def _kind(c: int) -> int:
    ch, cat = chr(c), unicodedata.category(chr(c))
    named = {"\n": "newline", ".": "stop", ",": "comma", "!": "shout", "?": "shout"} | dict.fromkeys("#*$%&|<>", "symbol")
    by = {"Ll": "lower", "Lu": "upper", "L": "letter", "N": "digit", "Z": "space", "P": "mark"}
    name = named.get(ch) or ("space" if ch.isspace() else by.get(cat) or by.get(cat[0]) or "other")
    return KINDS.index(name)


#: Character kinds of the first code points; those beyond count as "other" or, where letters are common, "letter".
TABLE = np.array([_kind(c) for c in range(0x530)] + [KINDS.index("letter")], "u1")


class WordCells(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = zlib.crc32(word.strip(".,;:!?()\"'").lower().encode("utf-8", "ignore")) % CELLS
        return out


_CELLS = WordCells()
SHAPE = (
    [f"share_{k}" for k in KINDS]
    + ["log_chars", "log_words", "word_length", "distinct_words", "repeated_next", "caps_words", "log_lines", "dup_lines", "stop_lines", "words_per_line"]
)


def features_of(text: str) -> tuple[list[float], np.ndarray]:
    """The text's shape, and the square roots of its word shares by hash cell, in single precision as rows keep them.
    An empty text is all zeros."""
    shape = np.zeros(len(SHAPE), "f4")
    if not text:
        return shape, np.zeros(CELLS, "f4")
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = np.bincount(TABLE[np.minimum(codes, len(TABLE) - 1)], minlength=len(KINDS)) / len(codes)
    words = text.split()
    n = len(words)
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    shape[: len(KINDS)] = kinds
    if n:
        shape[len(KINDS) :] = (
            np.log1p(len(codes)),
            np.log1p(n),
            sum(map(len, words)) / n,
            len(set(words)) / n,
            sum(map(eq, words, words[1:])) / n,
            sum(map(str.isupper, words)) / n,
            np.log1p(len(lines)),
            1 - len(set(lines)) / len(lines),
            sum(s.endswith((".", "!", "?", "\"", ":")) for s in lines) / len(lines),
            n / len(lines),
        )
    cells = np.sqrt(np.bincount(np.fromiter(map(_CELLS.__getitem__, words), "i8", n), minlength=CELLS) / max(n, 1))
    return shape, cells.astype("f4")


@dataclass
class BradleyTerry:
    edges: np.ndarray  # for each shape feature, the inner edges of its bins
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def expand(self, shape: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Standardised shape, one indicator for each bin of each shape feature, word cells, the constant left out."""
        z = np.clip((shape - self.mean) / self.scale, -5, 5)
        bins = (shape[:, :, None] > self.edges[None]).reshape(len(shape), -1)
        return np.hstack([z, bins, cells])

    def strength(self, shape: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return self.expand(shape, cells) @ self.weights


#: Labelled rows: a frame (label, features), or blocks of (features, labels).
Rows = DataFrame | list[tuple[np.ndarray, np.ndarray]]


def folded(rows: Rows, step: Callable, merge: Callable):
    """What ``merge`` makes of ``step(features, labels)`` of all blocks of rows; None without rows. Of a frame only one
    such result for each partition comes to the driver."""

    def fold(states: Iterator):
        state = next(states, None)
        for other in states:
            state = merge(state, other)
        return state

    if isinstance(rows, list):
        return fold(step(x, y) for x, y in rows)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("features").to_pylist()), "<f4").reshape(batch.num_rows, -1)
                yield x, batch.column("label").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = fold(step(x, y) for x, y in blocks(batches))
        if state is not None:
            yield pa.record_batch([pa.array([zlib.compress(pickle.dumps(state), 1)], pa.binary())], names=["state"])

    return fold(pickle.loads(zlib.decompress(bytes(r["state"]))) for r in rows.select("features", "label").mapInArrow(run, "state binary").collect())


def added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


def keys_of(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the floats."""
    bits = (values + values.dtype.type(0)).view(f"u{values.itemsize}")
    top = bits.dtype.type(1 << (8 * values.itemsize - 1))
    return np.where(bits & top, ~bits, bits | top).astype("u8")


def floats_of(keys: np.ndarray, kind: str) -> np.ndarray:
    bits = keys.astype(kind.replace("f", "u"))
    top = bits.dtype.type(1 << (8 * bits.itemsize - 1))
    return np.where(bits & top, bits ^ top, ~bits).view(kind).astype("f8")


def selected(rows: Rows, keys: Callable, ranks: list[np.ndarray], widths: tuple[int, ...]) -> list[np.ndarray]:
    """Of each group the keys at the given ranks (0 is the least), exactly, over all rows. ``keys(features, labels)``:
    the unsigned keys of each group in a block. A pass for each width settles as many bits, the highest first."""
    prefixes = [np.zeros(1, "u8") for _ in ranks]
    places = [np.zeros(len(r), "i8") for r in ranks]
    rest = [np.asarray(r, "i8") for r in ranks]
    low = sum(widths)
    for width in widths:
        high, low = low, low - width

        def counted(x: np.ndarray, y: np.ndarray, prefixes=prefixes, high=high, low=low, width=width) -> list[np.ndarray]:
            out = []
            for own, known in zip(keys(x, y), prefixes, strict=True):
                top = own >> np.uint64(high) if high < 64 else np.zeros_like(own)
                at = np.minimum(np.searchsorted(known, top), len(known) - 1)
                digit = (own >> np.uint64(low)).astype("i8") & ((1 << width) - 1)
                out.append(np.bincount(((at << width) | digit)[known[at] == top], minlength=len(known) << width))
            return out

        counts = folded(rows, counted, added)
        settled = []
        for g, known in enumerate(prefixes):
            sums = np.cumsum(counts[g].reshape(len(known), -1), axis=1)[places[g]]
            digit = (sums <= rest[g][:, None]).sum(1)
            rest[g] = rest[g] - np.where(digit > 0, sums[np.arange(len(digit)), digit - 1], 0)
            both, places[g] = np.unique((known[places[g]] << np.uint64(width)) | digit.astype("u8"), return_inverse=True)
            settled.append(both)
        prefixes = settled
    return [known[at] for known, at in zip(prefixes, places, strict=True)]


def class_quantiles(rows: Rows, counts: np.ndarray, parts: int) -> np.ndarray:
    """The quantiles 0, 1 / parts, ... 1 of each shape feature in each class, as np.quantile takes them of all rows."""
    n_shape = len(SHAPE)
    at = [np.linspace(0, 1, parts + 1) * (n - 1) for n in counts]
    below = [np.floor(p).astype("i8") for p in at]
    ranks = [np.concatenate([lo, np.minimum(lo + 1, n - 1)]) for lo, n in zip(below, counts, strict=True)]

    def keys(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        k = keys_of(np.ascontiguousarray(x[:, :n_shape].T))
        return [own for c in (0, 1) for own in k[:, y == c]]

    found = selected(rows, keys, [ranks[c] for c in (0, 1) for _ in range(n_shape)], (12, 7, 7, 6))
    out = np.zeros((2, parts + 1, n_shape))
    for i, own in enumerate(found):
        c, f = divmod(i, n_shape)
        lo, hi = floats_of(own, "f4").reshape(2, -1)
        out[c, :, f] = lo + (hi - lo) * (at[c] - below[c])
    return out


def nodes_of(s: np.ndarray, low: int, spacing: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The node below each strength, of ``n`` that begin at ``low``, and how far it is on its way to the next."""
    at = (s * NODES - low) / spacing
    node = np.clip(np.floor(at).astype("i8"), 0, n - 2)
    return node, at - node


def spread(s: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray]:
    """The first node, and how many strengths of each class lie at each, dealt to both neighbours by distance."""
    low = int(np.floor(s.min() * NODES))
    n = int(np.floor(s.max() * NODES)) - low + 2
    node, part = nodes_of(s, low, 1, n)
    return low, np.stack([np.bincount(node[y == c], 1 - part[y == c], n) + np.bincount(node[y == c] + 1, part[y == c], n) for c in (0, 1)])


def spread_merged(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    low, high = min(a[0], b[0]), max(x + h.shape[1] for x, h in (a, b))
    out = np.zeros((2, high - low))
    for x, h in (a, b):
        out[:, x - low : x - low + h.shape[1]] += h
    return low, out


def over(dist: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The mean of f(strength of a node - strength of another) over the others, at each node."""
    n = len(dist)
    size = 1 << (3 * n).bit_length()
    kernel = f(np.arange(1 - n, n) / NODES)
    return np.fft.irfft(np.fft.rfft(kernel, size) * np.fft.rfft(dist, size), size)[n - 1 : 2 * n - 1]


def sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -700, 700)))


def learn(rows: Rows, bins: int = 10, ridge: float = 1e-3, steps: int = 50) -> tuple[BradleyTerry, np.ndarray]:
    """The weights of least loss over all pairs of a good and a bad row, by Newton's method, and each class's rows.

    Strengths are counted at nodes 1/128 apart, between which the pairs' slopes are taken as linear: they are right to
    some 1e-6. With one class or no rows all strengths are 0 and the cut puts every document on that class's side (good
    where there is none).
    """
    n_shape = len(SHAPE)

    def moments(x: np.ndarray, y: np.ndarray):
        shape = x[:, :n_shape].astype("f8")
        return np.bincount(y, minlength=2), shape.mean(0), ((shape - shape.mean(0)) ** 2).sum(0)

    def moments_merged(a, b):
        n, share = a[0] + b[0], b[0].sum() / (a[0].sum() + b[0].sum())
        return n, a[1] + (b[1] - a[1]) * share, a[2] + b[2] + (b[1] - a[1]) ** 2 * a[0].sum() * share

    counts, mean, squares = folded(rows, moments, moments_merged) or (np.zeros(2, "i8"), None, None)
    if not counts.all():
        size = n_shape + n_shape * (bins - 1) + CELLS
        return BradleyTerry(np.zeros((n_shape, bins - 1)), np.zeros(n_shape), np.ones(n_shape), np.zeros(size), 1.0 if counts[0] else -1.0), counts
    # Bins are cut on both classes at equal weight, or the smaller would share one bin.
    even = class_quantiles(rows, counts, bins).reshape(-1, n_shape)
    edges = np.quantile(even, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    m = BradleyTerry(edges, mean, np.sqrt(squares / counts.sum()) + 1e-6, np.zeros(n_shape * bins + CELLS), 0.0)

    def distributions(w: np.ndarray) -> tuple[float, int, np.ndarray]:
        low, h = folded(rows, lambda x, y: spread(m.expand(x[:, :n_shape], x[:, n_shape:]) @ w, y), spread_merged)
        h = h / counts[:, None]
        return float(h[1] @ over(h[0], lambda t: np.logaddexp(0, -t))) + ridge / 2 * float(w @ w), low, h

    def derivatives(w: np.ndarray, low: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = h.shape[1]
        slopes = np.stack([over(h[1], sigmoid), -over(h[0], lambda t: sigmoid(-t))]) / counts[:, None]
        # The curvature of all pairs, with strengths dealt to coarser nodes: a sum of squares however far apart they are.
        spacing = COARSE * max(1, n // (128 * COARSE))
        first = low // spacing * spacing
        k = (low + n - 1 - first) // spacing + 2
        node, part = nodes_of((low + np.arange(n)) / NODES, first, spacing, k)
        coarse = np.stack([np.bincount(node, p * (1 - part), k) + np.bincount(node + 1, p * part, k) for p in h])
        apart = np.subtract.outer(np.arange(k), np.arange(k)) * spacing / NODES
        bend = sigmoid(apart) * sigmoid(-apart)
        curves = np.stack([bend @ coarse[1], bend @ coarse[0]]) / counts[:, None]

        def step(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
            x = m.expand(x[:, :n_shape], x[:, n_shape:])
            s = x @ w
            at, part = nodes_of(s, low, 1, n)
            gradient = x.T @ (slopes[y, at] * (1 - part) + slopes[y, at + 1] * part)
            at, part = nodes_of(s, first, spacing, k)
            square = (x * (curves[y, at] * (1 - part) + curves[y, at + 1] * part)[:, None]).T @ x
            dealt = np.zeros((len(y), k))
            dealt[np.arange(len(y)), at], dealt[np.arange(len(y)), at + 1] = 1 - part, part
            across = [(dealt[y == c].T @ x[y == c] / counts[c]).astype("f4") for c in (0, 1)]
            return [gradient, square.astype("f4"), *across]

        gradient, square, bad, good = folded(rows, step, added)
        cross = good.astype("f8").T @ bend @ bad
        return gradient + ridge * w, square - cross - cross.T + ridge * np.eye(len(w))

    w = m.weights
    loss, low, h = distributions(w)
    for _ in range(steps):
        gradient, curvature = derivatives(w, low, h)
        move = np.linalg.solve(curvature, gradient)
        if gradient @ move < 1e-7:
            break
        part, found = 1.0, distributions(w - move)
        while found[0] > loss - 1e-4 * part * float(gradient @ move) and part > 1e-3:
            part /= 2
            found = distributions(w - part * move)
        if found[0] > loss:
            break
        w, (loss, low, h) = w - part * move, found
    m.weights = w
    return m, counts


def fit(shape: np.ndarray, cells: np.ndarray, labels: np.ndarray, weights: np.ndarray, bins: int = 10, ridge: float = 1e-3, steps: int = 50) -> BradleyTerry:
    """Learn from arrays. ``weights``: how many documents a row stands for, for the quantile of the cut."""
    x, labels = np.hstack([shape, cells]).astype("f4"), np.asarray(labels, "i4")
    m, counts = learn([(x[i : i + 1000], labels[i : i + 1000]) for i in range(0, len(x), 1000)], bins, ridge, steps)
    if counts.all():
        s = m.strength(x[:, : len(SHAPE)], x[:, len(SHAPE) :])
        order = np.argsort(s, kind="stable")
        mass = np.cumsum(weights[order])
        at = int(np.searchsorted(mass, weights[labels == 0].sum() - 1e-9))
        m.cut = float((s[order[at]] + s[order[min(at + 1, len(s) - 1)]]) / 2)
    return m


def train(docs: DataFrame, labelled: DataFrame, label: str = "quality") -> BradleyTerry:
    """Fit on every row of ``labelled`` (doc_id, ``label`` 0 or 1) that has a document.

    Rows with another or null label are no examples. Features (600 bytes a document, whatever its length) meet the
    labels, not texts; the labelled ones are written to the shared folder, and each step reads them there.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [np.concatenate(features_of(x or "")).astype("<f4").tobytes() for x in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "features"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, features binary")
    wanted = labelled.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    rows = durable(found.join(wanted, "doc_id").select("label", "features"), "features")
    m, counts = learn(rows)
    if counts.all():
        n_shape = len(SHAPE)
        ranks = np.minimum(counts[0] + np.array([-1, 0]), counts.sum() - 1)
        at = selected(rows, lambda x, y: [keys_of(m.strength(x[:, :n_shape], x[:, n_shape:]))], [ranks], (16, 16, 16, 16))
        m.cut = float(floats_of(at[0], "f8").mean())
    forget(rows)
    return m


def score(docs: DataFrame, model: BradleyTerry, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add score (0..1) and predicted (score >= threshold) to every row, from the whole text alone.

    The score is the logistic function of the strength, shifted so that the model's cut scores ``threshold``.
    A null text is an empty one, whose features are all zero. Existing columns of the two names are replaced;
    all others stay.
    """
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    shift = np.log(threshold / (1 - threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                found = [features_of(x or "") for x in part.column(text).to_pylist()]
                s = model.strength(np.array([a for a, _ in found]), np.array([b for _, b in found]))
                value = 1 / (1 + np.exp(-np.clip(s - model.cut + shift, -30, 30)))
                yield pa.record_batch([*part.columns, pa.array(value), pa.array((value >= threshold).astype("i4"))], names=[*kept, "score", "predicted"])

    return docs.select(*kept).mapInArrow(run, schema)
