"""Language identification with string kernels.

Blended-spectrum presence kernel over byte n-grams of lower-cased text (2, 3 and 4 bytes), Nyström landmarks,
one-versus-rest kernel ridge regression. A text is a 0/1 row of hashed n-grams; the kernel against all
landmarks is one matrix product for each block of texts, and the class scores another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import prepare, slices

#: n-gram lengths and the number of hash cells of each.
SPECTRUM = {2: 4096, 3: 4096, 4: 4096}
WIDTH = sum(SPECTRUM.values())
#: Texts in a matrix product.
BLOCK = 256
#: Bytes of text whose n-grams are hashed at a time.
PART = 1 << 20
#: Classes of a text's number of n-grams, see familiarity().
SIZES = WIDTH.bit_length() + 1
#: A text is like no language below this share of the familiarity that all but a hundredth of the fitted rows reach.
FAMILIAR = 0.7
#: Landmarks at most, where there are so many languages that one for each is more.
MOST_LANDMARKS = 1024
#: ASCII bytes that are no letters become a space; other bytes stay.
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))

PREDICTED = "lang_pred string, score double"


def presence(texts: list[str]) -> np.ndarray:
    """0/1 rows: which hashed n-grams each text has. n-grams never span two texts."""
    raw = [x.lower().encode("utf-8", "ignore").translate(LETTERS) for x in texts]
    out = np.zeros(len(texts) * WIDTH, "u1")
    joined = b"".join(raw)
    ends = np.cumsum([len(x) for x in raw])
    for at in range(0, len(joined), PART):
        data = np.frombuffer(joined, "u1", min(PART + 3, len(joined) - at), at).astype("u4")  # n-grams that begin in the part
        row = np.searchsorted(ends, np.arange(at, at + len(data)), "right")
        base = 0
        code = data
        for n in range(2, 5):
            if len(data) < n:
                break
            code = (code[:-1] << np.uint32(8)) | data[n - 1 :]
            cell = (code * np.uint32(2654435761)) >> np.uint32(20)
            inside = row[: len(cell)] == row[n - 1 :]
            out[(row[: len(cell)] * WIDTH + base + cell)[inside]] = 1
            base += SPECTRUM[n]
    return out.reshape(len(texts), WIDTH)


def _normalised(x: np.ndarray) -> np.ndarray:
    """Each spectrum's part of a row divided by the root of its number of n-grams: the kernel is then a dot product."""
    x = x.astype("f4")
    at = 0
    for width in SPECTRUM.values():
        part = x[:, at : at + width]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1)) * np.float32(len(SPECTRUM) ** 0.5)
        at += width
    return x


def _size(n: np.ndarray) -> np.ndarray:
    """Bit length of each number, below ``SIZES``."""
    return np.minimum(np.ceil(np.log2(n + 1.0)).astype("i8"), SIZES - 1)


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # packed bits of each landmark's presence row
    weights: np.ndarray  # (landmarks + 1) x languages; the last row is the bias
    profiles: np.ndarray  # languages x WIDTH: the share of a language's rows that have an n-gram
    floors: np.ndarray  # by the bit length of a text's number of n-grams: familiarity() below which it is like no language

    def kernel(self, rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        return _normalised(rows) @ landmarks.T

    def unpacked(self) -> np.ndarray:
        return _normalised(np.unpackbits(self.landmarks, axis=1))

    def scores(self, rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        k = self.kernel(rows, landmarks)
        return k @ self.weights[:-1] + self.weights[-1]

    def familiarity(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean share of a language's rows that have the text's n-grams, at the language where that is most; number of n-grams).

        Unlike the scores, which sum to a constant over the languages, it is low for a text that is like none.
        """
        n = rows.sum(1, dtype="i8")
        return (rows.astype("f4") @ self.profiles.T).max(1, initial=0) / np.maximum(n, 1), n

    def unknown(self, rows: np.ndarray) -> np.ndarray:
        """Whether a text is less familiar than nearly all that the model was fitted on and that aren't longer."""
        value, n = self.familiarity(rows)
        return value < self.floors[_size(n)]


def fit(langs: list[str], bits: np.ndarray, landmarks: int = 128, ridge: float = 1e-3) -> LanguageModel:
    """Kernel ridge regression on the Nyström features of ``landmarks`` rows, dealt evenly to the languages.

    ``bits``: packed presence rows, in a random order. No rows give a model without languages.
    """
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    if not languages:
        return LanguageModel([], np.zeros((0, WIDTH // 8), "u1"), np.zeros((1, 0), "f4"), np.zeros((0, WIDTH), "f4"), np.zeros(SIZES))
    each = -(-landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(languages))])[:MOST_LANDMARKS]
    profiles = np.stack([sum(np.unpackbits(rows[i : i + BLOCK], axis=1).sum(0, dtype="f4") for i in range(0, len(rows), BLOCK)) / len(rows) for k in range(len(languages)) for rows in [bits[y == k]]])
    model = LanguageModel(languages, bits[chosen], np.zeros((1, 0), "f4"), profiles, np.zeros(SIZES))
    value, n = (np.concatenate(x) for x in zip(*(model.familiarity(np.unpackbits(bits[i : i + BLOCK], axis=1)) for i in range(0, len(bits), BLOCK)), strict=True))
    # The more n-grams a text has, the more rare ones are among them. Where no row is as short, the shortest decide.
    shortest = _size(n[n > 0]).min(initial=SIZES - 1)
    model.floors = np.array([FAMILIAR * np.quantile(value[known], 0.01) if (known := (n > 0) & (_size(n) <= max(size, shortest))).any() else 0 for size in range(SIZES)])
    marks = model.unpacked()
    values, vectors = np.linalg.eigh((marks @ marks.T).astype("f8"))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    k = np.concatenate([model.kernel(np.unpackbits(bits[i : i + BLOCK], axis=1), marks) for i in range(0, len(bits), BLOCK)])
    phi = np.hstack([k @ root, np.ones((len(k), 1))])
    # Each language has the same total weight, so a rare one isn't outvoted.
    weight = (len(y) / len(languages) / np.bincount(y))[y]
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    a = (phi * weight[:, None]).T @ phi + ridge * len(y) * np.eye(phi.shape[1])
    w = np.linalg.solve(a, (phi * weight[:, None]).T @ target)
    model.weights = np.vstack([root @ w[:-1], w[-1:]]).astype("f4")
    return model


def train(docs: DataFrame, per_language: int = 400, most_rows: int = 8192, landmarks: int = 128) -> LanguageModel:
    """Fit on a bounded sample of the rows of ``docs`` (doc_id, text, lang) with a non-null lang.

    The sample: of every language the ``per_language`` rows of least hash of doc_id, or as many fewer as there are more
    languages than ``most_rows`` has room for; one at least, so all are learned. (With more languages than ``most_rows``
    only that many, the most frequent.) Texts become packed bits on the executors, 1.5 KB each, before they reach the
    driver, with some to spare since a hash doesn't draw an exact number.
    """
    prepare(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_rows).collect()
    draw = (F.xxhash64(F.lit(29), F.col("doc_id")) / F.lit(2.0**64)) + 0.5
    each = min(per_language, max(1, most_rows // max(len(counts), 1)))
    spare = each + 4 * each**0.5 + 4
    rates = docs.sparkSession.createDataFrame([(r["lang"], spare / r["count"]) for r in counts], "lang string, _rate double")
    drawn = labelled.withColumn("lang", F.col("lang").cast("string")).join(F.broadcast(rates), "lang").where(draw < F.col("_rate"))  # at most ``most_rows`` rates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text"):
                for i in range(0, part.num_rows, BLOCK):
                    block = part.slice(i, BLOCK)
                    bits = np.packbits(presence([x or "" for x in block.column("text").to_pylist()]), axis=1)
                    yield pa.record_batch([block.column("draw"), block.column("lang"), pa.array([x.tobytes() for x in bits], pa.binary())], names=["draw", "lang", "bits"])

    sample = drawn.select(draw.alias("draw"), F.col("text").cast("string").alias("text"), "lang")
    rows, taken = [], {}
    for r in sorted(sample.mapInArrow(run, "draw double, lang string, bits binary").collect(), key=lambda r: (r["draw"], r["lang"], bytes(r["bits"]))):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= each:
            rows.append(r)
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), "u1").reshape(-1, WIDTH // 8)
    return fit([r["lang"] for r in rows], bits, landmarks)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", reject: bool = False) -> DataFrame:
    """Add lang_pred and score to every row, from the whole text alone.

    ``und`` with score 0 where the text is null, has no letter, or the model knows no language. Ties go to the
    first language in alphabetical order. The score is the winner's regression value, of which 1 means
    "exactly like its language" and -1 "exactly unlike", brought to 0..1. Existing columns of the two names
    are replaced; all others stay. With ``reject``, texts like no language of the model are ``und`` with score 0 too.
    """
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = model.unpacked()
        for batch in slices(batches, text):
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                xs = [x or "" for x in part.column(text).to_pylist()]
                pred, score = ["und"] * len(xs), np.zeros(len(xs))
                if model.languages:
                    rows = presence(xs)
                    values = model.scores(rows, marks)
                    unlike = model.unknown(rows) if reject else np.zeros(len(xs), bool)
                    best = values.argmax(1)
                    top = np.clip((values[np.arange(len(xs)), best] + 1) / 2, 0, 1)
                    for j, x in enumerate(xs):
                        if has_letter(x) and not unlike[j]:
                            pred[j], score[j] = model.languages[best[j]], top[j]
                yield pa.record_batch([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, schema)
