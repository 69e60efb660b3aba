"""Mixing sources to target weights by Poisson replication.

A source s with n_s documents and target weight w_s gets the mean repetition rate
lambda_s = total * w_s / (sum of weights present * n_s). Each document draws its number of copies from the Poisson
distribution with that mean: a uniform number made from a hash of (seed, document key) is pushed
through the inverse of the distribution function. The draw needs no neighbour, so it is the same in
any partitioning and after any retry. Rates above CHUNK_RATE are drawn as sums of independent draws
with smaller means, which is the same distribution and keeps exp(-rate) away from underflow. Documents
are then exploded by their counts and dealt out by a hash of (seed, key, copy), sorted by it in each partition: a
global shuffle that is repeatable.

Defined results: null sources form a source of their own, named by null in the weights; a source
without a weight has weight 0 and goes; null document keys draw like the empty key; rows with the same
key draw the same count; null and empty texts are mixed like others; an empty table gives an empty
result. Extra columns are carried along; columns named copy, n_copies or shuffle_key are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

CHUNK_RATE = 16.0
#: P(X > MAX_STEP) is below 2^-52 for a mean of CHUNK_RATE: no draw reaches it.
MAX_STEP = 72
SEED = "mix-1"
#: Up to so many counted sources the rates are broadcast; beyond, the optimizer joins them by a shuffle.
MAX_BROADCAST_SOURCES = 100_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k whose cumulative probability exceeds u."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["k"] + F.when(u >= acc["cdf"], 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_STEP)), start, step, lambda acc: acc["k"])


def copies(key: Column, rate: Column, seed: str = SEED) -> Column:
    """Number of copies of a document: a Poisson draw with the given mean, seeded by its key."""
    chunks = F.greatest(F.lit(1), F.ceil(rate / CHUNK_RATE).cast("int"))
    draw = F.aggregate(
        F.sequence(F.lit(1), chunks),
        F.lit(0),
        lambda acc, c: acc + poisson_inverse(uniform(F.lit(seed), key, c.cast("string")), rate / chunks),
    )
    return F.when(rate > 0, draw).otherwise(F.lit(0))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None, total: float | None, source_col: str = "source") -> DataFrame:
    """One row per source: source, rate. Without weights every source counts alike; without total it is the number of rows."""
    sizes = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.lit(1.0))
    else:
        w = F.lit(0.0)
        for name, weight in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(w)
        sizes = sizes.withColumn("w", w)
    rows, weight, sources = sizes.agg(F.sum("n"), F.sum("w"), F.count(F.lit(1))).first()
    amount = float(total) if total is not None else float(rows or 0)
    mean = F.lit(amount / weight) * F.col("w") / F.col("n") if weight else F.lit(0.0)
    out = sizes.select("source", mean.alias("rate"))
    return F.broadcast(out) if sources <= MAX_BROADCAST_SOURCES else out


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with each row repeated as drawn, globally shuffled; adds n_copies, copy (from 0) and shuffle_key."""
    name, mean = free(docs, "__source"), free(docs, "__rate")
    rate = rates(docs, weights, total, source_col).select(F.col("source").alias(name), F.col("rate").alias(mean))
    joined = docs.join(rate, F.col(f"`{source_col}`").eqNullSafe(F.col(name)), "left")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    drawn = joined.withColumn("n_copies", copies(key, F.coalesce(mean, F.lit(0.0)), seed)).drop(name, mean).where("n_copies > 0")
    many = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    dealt = many.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("deal"), key, F.col("copy").cast("string")).cast("binary")))
    return dealt.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
