"""Clusters of integer vectors around centroids, exact on every machine and partitioning.

Components are made integers, floor(scale * x). Every round assigns each vector to the nearest centroid and moves each centroid that
has vectors to floor(sum / count), component by component; ties go to the smaller number, a centroid without vectors stays.

Distances come from |x|^2 - 2 x.c + |c|^2 with one matrix product in float64 for a block of vectors. While
dimensions * (largest |x| + largest |c|)^2 is below 2^53, every intermediate value is an integer that float64 holds
exactly, in any order of summation; vectors beyond that bound are computed with Python's integers. Each
task gives one row of counts and sums for a cluster, which RDD.treeAggregate combines; the sums are exact integers.
Nothing but the centroids goes to the driver. The table is scanned once a round; no vector is shuffled.

Defined results: a null vector, one of another length and one with a null or non-finite component is left out; with fewer vectors
than centroids there are as many centroids as vectors; equal ids are separate rows, a null id counts as empty in the
hash that orders the first centroids, and ties there go by the components; a distance or sum beyond a 64-bit integer is
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLUSTERS, ROUNDS, SCALE, SEED, DIMENSIONS = 16, 3, 64, 1, 64
#: Below it float64 holds all integers.
EXACT = 1 << 53
#: Components in int64 are smaller than this, so that their sums over an Arrow batch don't overflow.
SMALL = 1 << 45
#: Vectors of a matrix product.
BLOCK = 4096

Centroids = list[list[int]]


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, x): vectors of the right length whose components are all finite numbers, as doubles."""
    x = F.col(f"`{vec_col}`").cast("array<double>")
    fine = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return df.select(F.col(f"`{id_col}`").alias("id"), x.alias("x")).where(F.coalesce(fine, F.lit(False)))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python's integers if one is too large for it. scale: a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < SMALL:
        return y.astype(np.int64)
    # multiplied by a power of two a double of that size is an integer still
    return np.array([[int(v) * scale if abs(v) >= SMALL else int(f) for v, f in zip(a, b, strict=True)] for a, b in zip(x.tolist(), y.tolist(), strict=True)], dtype=object)


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, list[int]]:
    """Number of the nearest centroid and squared distance to it, for each row."""
    label, dist = np.zeros(len(x), np.int64), [0] * len(x)
    reach = isqrt((EXACT - 1) // x.shape[1])
    far = max(abs(v) for c in centroids for v in c)
    top = np.abs(x).max(1)
    easy = np.flatnonzero(top + far <= reach) if far <= reach else np.zeros(0, np.int64)
    c = np.array(centroids, dtype=object)
    if len(easy):
        cf = c.astype(np.float64)
        cc = (cf * cf).sum(1)
        for lo in range(0, len(easy), BLOCK):
            at = easy[lo : lo + BLOCK]
            xf = x[at].astype(np.float64)
            d = (xf * xf).sum(1)[:, None] - 2.0 * (xf @ cf.T) + cc[None, :]
            label[at] = d.argmin(1)
            for i, v in zip(at.tolist(), d.min(1).tolist(), strict=True):
                dist[i] = int(v)
    for i in np.setdiff1d(np.arange(len(x)), easy).tolist():
        row = x[i].astype(object)
        d = [sum(int(a) * int(a) for a in row - k) for k in c]
        dist[i] = min(d)
        label[i] = d.index(dist[i])
    return label, dist


def _rows(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x")
            yield batch.column("id"), integers(x.flatten().to_numpy().reshape(batch.num_rows, -1), scale)


def _partial(centroids: Centroids, scale: int):
    """Rows of a partition -> one row (cluster, totals) for each cluster met: count, sum of distances, sums of components, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for _, x in _rows(batches, scale):
            label, dist = nearest(x, centroids)
            for c in np.unique(label).tolist():
                at = np.flatnonzero(label == c)
                new = [len(at), sum(dist[i] for i in at.tolist()), *(int(v) for v in x[at].sum(0))]
                held[c] = [a + b for a, b in zip(held[c], new, strict=True)] if c in held else new
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([json.dumps(v) for v in held.values()], pa.string())], names=["cluster", "totals"])

    return run


def _add(held: dict[int, list[int]], row) -> dict[int, list[int]]:
    return _both(held, {row["cluster"]: json.loads(row["totals"])})


def _both(a: dict[int, list[int]], b: dict[int, list[int]]) -> dict[int, list[int]]:
    for c, new in b.items():
        a[c] = [x + y for x, y in zip(a[c], new, strict=True)] if c in a else new
    return a


def totals(vectors: DataFrame, centroids: Centroids, scale: int = SCALE) -> dict[int, list[int]]:
    """By cluster: count, sum of squared distances, sums of components. At most a row for each cluster and task moves."""
    return vectors.mapInArrow(_partial(centroids, scale), "cluster bigint, totals string").rdd.treeAggregate({}, _add, _both)


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED, scale: int = SCALE) -> Centroids:
    """Those of the k smallest hashes of `seed:id`, in that order."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "x")
    top = hashed.orderBy("h", "x").limit(k).collect()
    return [[int(v) for v in integers(np.array([r["x"]]), scale)[0]] for r in top]


def train(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> Centroids:
    """Centroids after some rounds over all vectors."""
    centroids = first_centroids(vectors, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        for c, (n, _, *sums) in totals(vectors, centroids, scale).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def _long(v: int) -> int | None:
    return v if -(1 << 63) <= v < 1 << 63 else None


def _assigned(centroids: Centroids, inertia: dict[int, int], scale: int):
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    every = _long(sum(inertia.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _rows(batches, scale):
            label, dist = nearest(x, centroids)
            at = label.tolist()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(at, pa.int32()), pa.array([_long(d) for d in dist], pa.int64()), pa.array([_long(inertia[c]) for c in at], pa.int64()), pa.array([every] * len(at), pa.int64()), pa.array([shas[c] for c in at], pa.string())],
                names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return run


def assign(vectors: DataFrame, centroids: Centroids, scale: int = SCALE) -> DataFrame:
    """A row for each vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    kind = vectors.schema["id"].dataType.simpleString()
    inertia = {c: v[1] for c, v in totals(vectors, centroids, scale).items()} if centroids else {}
    return vectors.mapInArrow(_assigned(centroids, inertia, scale), f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """Centroids trained over all vectors of df, and every vector assigned. df is scanned once a round and three times more."""
    vectors = kept_vectors(df, id_col, vec_col, dimensions)
    return assign(vectors, train(vectors, k, rounds, seed, scale), scale)
