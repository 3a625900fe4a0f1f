"""Near-duplicate removal at a Jaccard similarity, on SimHash fingerprints.

Two texts that share four fifths of their five-word shingles differ in about ten of 64 bits, beyond the reach of
a bit distance that still selects. So besides its whole text's fingerprint a document has fingerprints of a few
passages, each of four shingles in a row that begin at one of the least shingle hashes: near copies choose the
same places, and most are untouched by an edit. Whole texts within two bits are linked by the popcount grid join of
simhash.py and meet where links connect them, passages where equal. Those that meet are verified by the Jaccard
similarity of their shingle sets (hashes of 32 bits), each pair, and the links that stand are followed to classes. Documents of a passage that very many share meet
by their rarest shingles instead, enough of them that similar ones can't fail to; see prefixes() and crossed().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import durable, forget, prepare, slices
from lakemill.llm.components import components
from lakemill.llm.simhash import fingerprint, near_links, shingle_hashes

PASSAGES = 6
PASSAGE_SHINGLES = 4
#: Documents that one bucket compares with each other; for keys with more see buckets(), prefixes() and crossed().
BUCKET = 1024
#: Bits of a hash cell in which shingles are counted.
CELL_BITS = 18
#: Shingles that the matrix product takes at a time.
COLUMNS = 4096

PROFILE = "doc_id long, text_hash binary, fp long, passages array<long>, shingles binary"


def profiles(docs: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """A row for each document: hash of its text, fingerprints, and its distinct shingle hashes (32 bits) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, fps, passages, sets = [], [], [], []
            for x in part.column("text").to_pylist():
                raw = shingle_hashes(x or "", shingle)
                values = raw.view(">u8").ravel().astype("u8") if len(raw) else np.zeros(0, "u8")
                hashes.append(xxhash.xxh3_128_digest((x or "").encode("utf-8", "surrogatepass")))
                fps.append(int.from_bytes(fingerprint(raw), "big", signed=True))
                starts = np.unique(values, return_index=True)[1][:PASSAGES]
                passages.append(sorted({int.from_bytes(fingerprint(raw[i : i + PASSAGE_SHINGLES]), "big", signed=True) for i in starts.tolist()}))
                sets.append(np.unique((values >> np.uint64(32)).astype("u4")).tobytes())
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(hashes, pa.binary()), pa.array(fps, pa.int64()), pa.array(passages, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
                names=["doc_id", "text_hash", "fp", "passages", "shingles"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PROFILE)


def buckets(keys: DataFrame) -> DataFrame:
    """(bucket, rep) from (key, rep): the documents of each key that has two or more, ``BUCKET`` or so to a bucket.

    A key with more (a passage that many documents share, or very many near copies) is dealt by a hash into as
    many buckets as it needs, each with the key's smallest document added. That links most of a large group of
    near copies; the pairs that it separates are left to prefixes() and crossed().
    """
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where("n > 1")
    spread = keys.join(counts, "key").withColumn("parts", F.ceil(F.col("n") / BUCKET))
    own = F.pmod(F.xxhash64("rep"), F.col("parts"))
    parts = F.when(F.col("rep") == F.col("first"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own))
    return spread.select("key", "rep", F.explode(parts).alias("part")).select(F.xxhash64("key", "part").alias("bucket"), "rep")


def hot(keys: DataFrame) -> DataFrame:
    """The rows of (key, rep, ...) whose key has more documents than a bucket holds."""
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key"), "key")


def cells_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles * np.uint32(2654435761)) >> np.uint32(32 - CELL_BITS)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of ``sets`` (shingles) fall in each of a fixed number of hash cells. A task adds up its own, so
    that it sends a row a cell at most, and so does the sum to the driver, whatever the number of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, "i8")
        for batch in batches:
            for raw in batch.column("shingles").to_pylist():
                counts += np.bincount(cells_of(np.frombuffer(raw, "<u4")), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["cell", "n"])

    found = sets.select("shingles").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << CELL_BITS, "i8")
    out[found["cell"].to_numpy("i8")] = found["n"].to_numpy("i8")
    return out


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(key, rep, root) from (rep, root, shingles): keys of which any two sets of Jaccard similarity ``least`` or more
    share one, those left out that only sets of one root have.

    All shingles have one order, those of cells with few shingles first. Similar sets share at least the share ``least``
    of either, so not all that they share can be among the last of one: both have one of it among their first
    n - ceil(least n) + 1. Sets without shingles, which are alike, have a key of their own. That holds for any order;
    this one makes keys that few sets share.
    """
    order_of = frequencies(sets)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for raw in batch.column("shingles").to_pylist():
                own = np.frombuffer(raw, "<u4")
                order = np.lexsort((own, order_of[cells_of(own)]))
                # As similar() does, a thousandth less than what ``least`` asks for is enough.
                keys.append(own[order[: len(own) - int(np.ceil(least * len(own) - 1e-3)) + 1]].astype("i8") if len(own) else np.array([-1], "i8"))
            sizes = [len(k) for k in keys]
            rep, root = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("rep", "root"))
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, "i8"), *keys])), pa.array(rep), pa.array(root)], names=["key", "rep", "root"])

    rows = durable(sets.select("rep", "root", "shingles").mapInArrow(first, "key long, rep long, root long").distinct(), "prefixes")
    several = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return rows.join(several, "key", "left_semi")


def crossed(keys: DataFrame) -> DataFrame:
    """(bucket, rep) from the (key, rep, root) of keys with more documents than a bucket holds: block against block, so
    that every two documents of a key meet, but for those of the key's largest root, which are of one class already.

    Few keys come here: a shingle is among the first of a set that has only common ones, and sets that differ in
    less are near copies. Where they aren't, the comparisons grow with the square of the documents outside that class.
    """
    classes = keys.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = classes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    half = BUCKET / 2
    inner, outer = F.ceil(F.col("top.n") / half), F.ceil((F.col("all") - F.col("top.n")) / half)
    dealt = keys.join(largest.select("key", F.col("top.root").alias("main"), inner.alias("inner"), outer.alias("outer")).where("outer > 0"), "key")
    dealt = dealt.withColumn("inside", F.col("root") == F.col("main"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))) + F.when(F.col("inside"), F.col("outer")).otherwise(F.lit(0))
    last = F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    met = dealt.withColumn("own", own).select("key", "rep", "own", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    return met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "rep")


def similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the number of the first set of its class, where sets of Jaccard similarity ``least`` or more
    are linked. Intersections are products of 0/1 rows over the values that two sets or more have: exact."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], "f4")
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes.astype("i8"))
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    both = np.zeros((n, n), "f4")
    for at in range(0, int(shared.sum()), COLUMNS):
        inside = (column >= at) & (column < at + COLUMNS)
        x = np.zeros((n, COLUMNS), "f4")
        x[row[inside], column[inside] - at] = 1
        both += x @ x.T
    union = sizes[:, None] + sizes[None] - both
    linked = both >= np.float32(least) * union - 1e-3
    np.fill_diagonal(linked, True)
    label = np.arange(n)
    while True:
        least_label = np.where(linked, label[None], n).min(1)
        if (least_label == label).all():
            return label
        label = least_label


def verified(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) from (bucket, rep, shingles): within each bucket every document to the first of its class there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bucket, reps, sets = None, [], []

        def links() -> pa.RecordBatch:
            met = sorted({*zip(reps, sets, strict=True)})  # a document may meet itself, or come with several texts
            if len(met) < 2:
                return pa.record_batch([pa.array([], pa.int64())] * 2, names=["a", "b"])
            ids = np.array([r for r, _ in met], "i8")
            first = ids[similar([np.frombuffer(x, "<u4") for _, x in met], least)]
            apart = first != ids
            return pa.record_batch([pa.array(first[apart]), pa.array(ids[apart])], names=["a", "b"])

        for batch in batches:
            for bucket, rep, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != held_bucket:
                    if len(reps) > 1:
                        yield links()
                    held_bucket, reps, sets = bucket, [], []
                reps.append(rep)
                sets.append(raw)
        if len(reps) > 1:
            yield links()

    return rows.repartition("bucket").sortWithinPartitions("bucket", "rep").select("bucket", "rep", "shingles").mapInArrow(run, "a long, b long")


def duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id) for the documents of every class of two or more: class_id is its smallest doc_id.

    Equal texts are one class, and so are those linked by a Jaccard similarity of ``similarity`` or more of
    their distinct ``shingle``-word shingles (lower-cased A-Z, words between ASCII white space; the whole
    sequence where there are fewer words). Texts without words, null ones too, are alike. Rows with a null
    doc_id are left out; rows that repeat a doc_id are one document, whose texts share their links.
    """
    prepare(docs.sparkSession)
    # A function of each row alone: what a lost executor held is computed again from its rows.
    found = profiles(docs, shingle, doc_id, text).where("doc_id IS NOT NULL").persist(StorageLevel.DISK_ONLY)
    firsts = durable(found.groupBy("text_hash").agg(F.min("doc_id").alias("rep")), "firsts")
    own = found.select("doc_id", "text_hash").join(firsts, "text_hash").select("doc_id", "rep")
    small = found.select("doc_id", "text_hash", "fp", "passages")
    thin = durable(small.join(firsts, (small.text_hash == firsts.text_hash) & (small.doc_id == firsts.rep)).select("rep", "fp", "passages"), "thin")
    near = components(near_links(thin.select("fp").distinct()))
    met = thin.join(near, thin.fp == near.node, "left").select(F.coalesce("root", "fp").alias("key"), "rep")
    keys = durable(thin.select(F.explode("passages").alias("key"), "rep").unionByName(met).distinct(), "keys")
    forget(near)
    sets = found.select(F.col("doc_id").alias("rep"), "shingles")
    pairs = [durable(verified(buckets(keys).join(sets, "rep"), similarity), "pairs")]
    crowded = hot(keys).select("rep").distinct()
    if not crowded.isEmpty():
        known = components(pairs[0])
        rooted = crowded.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"))
        crowded = durable(rooted.join(sets, "rep"), "crowded")
        rare = durable(prefixes(crowded, similarity), "rare")
        crowded_sets = crowded.select("rep", "shingles")
        pairs.append(durable(verified(buckets(rare).join(crowded_sets, "rep"), similarity), "pairs"))
        left = durable(hot(rare), "left")
        if not left.isEmpty():
            pairs.append(durable(verified(crossed(left).join(crowded_sets, "rep"), similarity), "pairs"))
        for x in (known, crowded, rare, left):
            forget(x)
    for x in (thin, keys):
        forget(x)
    links = own.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = components(reduce(DataFrame.unionByName, pairs, links))
    for x in pairs:
        forget(x)
    found.unpersist()
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"))


def without_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the first of its class, or in none; see duplicates(). All columns stay."""
    later = duplicates(docs, shingle, similarity, doc_id, text).where("doc_id <> class_id").select(F.col("doc_id").alias("_later"))
    return docs.join(later, F.col(doc_id).cast("long") == F.col("_later"), "left_anti")
