"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they are). The
exponent is bisected until the weights' entropy reaches a target or no source is repeated beyond a limit. The
weights, times a token budget, are then realised as block permutations: each source is gone through in passes,
each pass in its own random order, the last pass up to the budget; positions are spread so that every block of
the output holds the sources at their weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm.common import durable, forget

#: Bits of a document's place in a pass, and how many of them one round of the search for the cut resolves.
BITS, DIGIT = 60, 10
#: Candidates for the exponent in one round of the bisection; a round narrows the range by this factor.
CANDIDATES = 16
ROUNDS = 8


@dataclass(frozen=True)
class Mix:
    """What to reach. Entropy: as a share of that of equal weights; None: no target. Budget: tokens to draw; None:
    the least with which no source is cut, so that each document is drawn once at least."""

    entropy: float | None = 0.97
    most_repeats: float | None = 4.0
    budget: int | None = None
    block_tokens: int = 1_000_000
    seed: int = 23


def source_key(source):
    """A text for each source, null being a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def n_tokens(text):
    """Words between ASCII white space."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.size(F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def exponent(sources: DataFrame, mix: Mix) -> tuple[float, dict]:
    """The largest exponent that meets the entropy target, or, where the limit on repetition forbids that or there is
    no target, the smallest that the limit allows; 1 with neither.

    ``sources``: key, tokens. All sums are taken by Spark, for a batch of exponents at a time, so the number of
    sources isn't bounded by the driver. Sources without tokens take no part.
    """
    some = sources.where("tokens > 0")
    total, n, least, most = some.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return 1.0, {"total": 0, "norm": 1.0, "budget": 0}
    p = F.col("tokens") / F.lit(float(total))

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        """For each exponent the norm and the entropy of the weights."""
        row = some.agg(*(F.sum(F.pow(p, F.lit(a))) for a in alphas), *(F.sum(F.pow(p, F.lit(a)) * F.log(p)) for a in alphas)).first()
        k = len(alphas)
        return [(row[i], math.log(row[i]) - a * row[k + i] / row[i]) for i, a in enumerate(alphas)]

    def met(alpha: float, norm: float, entropy: float) -> tuple[bool, bool]:
        budget = mix.budget or total * norm * (most / total) ** (1 - alpha)
        repeats = budget / total / norm * (least / total) ** (alpha - 1)
        return mix.entropy is None or n == 1 or entropy >= mix.entropy * math.log(n) - 1e-9, mix.most_repeats is None or repeats <= mix.most_repeats + 1e-9

    # Entropy falls and repetition falls as the exponent grows. First the largest that meets the entropy, then,
    # if that repeats too much, the smallest that doesn't.
    def bisect(keep_low) -> tuple[float, float]:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / CANDIDATES for i in range(CANDIDATES + 1)]
            ok = [keep_low(a, *s) for a, s in zip(grid, sums(grid), strict=True)]
            if all(ok):
                return high, high
            k = max([i for i, x in enumerate(ok) if x], default=-1)
            if k < 0:
                return low, low
            low, high = grid[k], grid[k + 1]
        return low, high

    # The bisection keeps low where its test holds and high where it doesn't.
    alpha = bisect(lambda *x: met(*x)[0])[0] if mix.entropy is not None else 0.0 if mix.most_repeats is not None else 1.0
    (norm, entropy) = sums([alpha])[0]
    if not met(alpha, norm, entropy)[1]:
        alpha = bisect(lambda *x: not met(*x)[1])[1]
        (norm, entropy) = sums([alpha])[0]
    budget = mix.budget or total * norm * (most / total) ** (1 - alpha)
    return alpha, {"total": total, "norm": norm, "budget": budget, "entropy": entropy}


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """What is drawn of each source: key, weight, passes (whole ones), cut (places below it are drawn once more), turns.

    ``rows``: key, place, tokens of each document. The cut is found by a radix search: sums by the next digits of
    the place, within the one prefix where the budget ends, at most 1024 a source and round. A source without
    tokens can't be weighed and is drawn once.
    """
    sources = durable(rows.groupBy("key").agg(F.sum("tokens").alias("tokens")), "sources")
    alpha, found = exponent(sources, mix)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(found["total"] or 1)), F.lit(alpha)) / F.lit(found["norm"])).otherwise(0.0)
    quota = weight * F.lit(float(found["budget"]))
    turns = F.when(F.col("tokens") > 0, quota / F.col("tokens")).otherwise(1.0)
    state = sources.select("key", "tokens", weight.alias("weight"), turns.alias("turns")).withColumn("passes", F.floor(F.col("turns") + 1e-9))
    state = state.withColumn("left", F.floor((F.col("turns") - F.col("passes")) * F.col("tokens") + 1e-6)).withColumns({"prefix": F.lit(0).cast("long"), "open": F.col("left") > 0})
    state = durable(state, "plan")
    by_key = Window.partitionBy("key").orderBy("digit")  # a row for each of 1024 digits at most
    for k in range(BITS // DIGIT):
        shift = BITS - DIGIT * (k + 1)
        inside = rows.join(state.where("open").select("key", "prefix"), "key").where(F.shiftright("place", shift + DIGIT) == F.col("prefix"))
        digits = inside.groupBy("key", F.shiftright("place", shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"))
        running = digits.withColumn("upto", F.sum("sum").over(by_key)).join(state.select("key", "left"), "key")
        # The first digit that doesn't fit whole. All fit only if rounding left the last one over: then nothing is cut.
        ends = running.where(F.col("upto") > F.col("left")).groupBy("key").agg(F.min_by(F.struct("digit", (F.col("left") - (F.col("upto") - F.col("sum"))).alias("left"), "n"), "digit").alias("end"))
        joined = state.join(ends, "key", "left")
        updated = joined.select(
            "key", "tokens", "weight", "turns", "passes",
            F.when(F.col("open") & F.col("end").isNotNull(), F.col("end.left")).otherwise(F.col("left")).alias("left"),
            F.when(F.col("open"), F.when(F.col("end").isNotNull(), F.shiftleft("prefix", DIGIT) + F.col("end.digit")).otherwise(F.shiftleft(F.col("prefix") + 1, DIGIT))).otherwise(F.shiftleft("prefix", DIGIT)).alias("prefix"),
            (F.col("open") & F.col("end").isNotNull() & (F.col("end.n") > 1)).alias("open"),
        )
        new = durable(updated, "plan")
        forget(state)
        state = new
        if state.where("open").isEmpty():
            state = state.withColumn("prefix", F.shiftleft("prefix", shift))
            break
    forget(sources)
    return state.select("key", "tokens", "weight", "turns", F.col("passes").cast("long").alias("passes"), F.col("prefix").alias("cut"))


def place(key, doc_id, salt, seed: int):
    """A document's place in its source's order, 60 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, doc_id, salt), 64 - BITS)


def draw(docs: DataFrame, mix: Mix, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(drawn, plan): every drawn copy of every document, and what was decided for each source.

    ``drawn`` has the columns of ``docs`` and _key, _pass, _block, _position: _position orders the whole output,
    _block is the part of it, of about ``block_tokens``, that the copy lies in. Null sources are a source of their
    own, null texts have no tokens. Repeated rows share a place and are cut or drawn together. No rows give none.
    The sources' table is joined by Spark's own choice: broadcast where its size, known from its files, is
    under the session's threshold, else a sort-merge join whose hot keys adaptive execution splits.
    """
    keyed = docs.withColumn("_key", source_key(F.col(source)))
    keyed = keyed.withColumn("_place", place(F.col("_key"), F.col(doc_id), F.lit(0), mix.seed))
    rows = durable(keyed.select(F.col("_key").alias("key"), F.col("_place").alias("place"), n_tokens(F.col(text)).alias("tokens")), "rows")
    chosen = durable(plan(rows, mix), "chosen")
    forget(rows)
    budget = chosen.agg(F.sum(F.col("turns") * F.col("tokens"))).first()[0] or 0.0
    blocks = max(1, math.ceil(budget / mix.block_tokens))
    small = chosen.select(F.col("key").alias("_key"), "passes", "cut", "turns")
    times = F.col("passes") + F.when(F.col("_place") < F.col("cut"), 1).otherwise(0)
    drawn = keyed.join(small, "_key").withColumn("_times", times).where("_times > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    # The last pass goes up to the cut, in order of the place itself, so that its copies fill the turns that are left;
    # each whole pass has an order of its own.
    last = F.col("_pass") == F.col("passes")
    within = F.when(last, F.col("_place")).otherwise(place(F.col("_key"), F.col(doc_id), F.col("_pass") + 1, mix.seed)) / F.lit(float(2**BITS))
    drawn = drawn.withColumn("_position", F.least((F.col("_pass") + within) / F.greatest("turns", F.lit(1e-9)), F.lit(1 - 1e-12)))
    drawn = drawn.withColumn("_block", F.floor(F.col("_position") * blocks))
    return drawn.drop("_place", "_times", "passes", "cut", "turns"), chosen


def mixed(docs: DataFrame, mix: Mix, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn copies with the columns of ``docs`` alone, block by block and in order within each."""
    drawn, _ = draw(docs, mix, source, doc_id, text)
    return drawn.repartition("_block").sortWithinPartitions("_block", "_position").select(docs.columns)
