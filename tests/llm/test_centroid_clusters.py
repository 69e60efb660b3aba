import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from quillmill.llm import centroid_clusters as C

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain(rows, k=16, rounds=3, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(Fraction(float(np.float32(x))) * 64) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds if cents else 0):
        label = assign()
        for c in range(len(cents)):
            mine = [v for (_, v), (a, _) in zip(kept, label, strict=True) if a == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    label = assign() if cents else []
    fit = lambda v: v if abs(v) < 1 << 63 else None
    per = {c: sum(d for a, d in label if a == c) for c, _ in label}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, a, fit(d), fit(per[a]), fit(sum(per.values())), shas[a]) for (i, _), (a, d) in zip(kept, label, strict=True)), key=str)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(parts)
    got = C.centroid_clusters(df).collect()
    want = plain(rows)
    assert sorted(map(tuple, got), key=str) == want
    return want


def vectors(rng, many, scale=1.0):
    spots = [[rng.gauss(0, scale) for _ in range(64)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, scale / 4) for x in rng.choice(spots)]) for i in range(many)]


def test_against_brute_force(spark):
    want = check(spark, vectors(random.Random(1), 300))
    assert len({r[1] for r in want}) > 5


def test_equal_on_any_partitioning(spark):
    rows = vectors(random.Random(2), 200)
    assert check(spark, rows, 1) == check(spark, rows, 7)


def test_rows_that_do_not_count_and_ties(spark):
    rng = random.Random(3)
    rows = vectors(rng, 40)
    one = rows[0][1]
    rows += [(900, None), (901, []), (902, one[:-1]), (903, [*one[:-1], None]), (904, [*one[:-1], float("nan")]), (905, [*one[:-1], float("-inf")]), (None, one), (None, [0.0] * 64)]
    rows += [(7, one)] * 30 + [(i, [0.0] * 64) for i in range(50, 70)]  # equal vectors: centroids coincide, and the smaller number takes all
    want = check(spark, rows)
    assert len(want) == 40 + 2 + 30 + 20


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = vectors(rng, 60, 1e5)
    rows += [(100 + i, [x * 2.0**20 for x in v]) for i, v in vectors(rng, 20, 1e5)]
    rows += [(200, [3e38] * 64), (201, [-3e38] * 64), (202, [1e30, -1e30] * 32)]
    want = check(spark, rows)
    assert any(r[4] is None for r in want)


def test_few_and_no_vectors(spark):
    assert len(check(spark, vectors(random.Random(5), 3))) == 3
    assert check(spark, []) == []


def test_bound_decides_between_blas_and_integers():
    rng = np.random.default_rng(6)
    for top in (1 << 10, 1 << 23, 1 << 24, 1 << 40):
        x = rng.integers(-top, top, (40, 64))
        cents = rng.integers(-top, top, (5, 64)).tolist()
        label, dist = C.nearest(x, cents)
        for row, a, d in zip(x.tolist(), label.tolist(), dist, strict=True):
            full = [sum((p - q) ** 2 for p, q in zip(row, c, strict=True)) for c in cents]
            assert (a, d) == (full.index(min(full)), min(full))


def test_clashing_names(spark):
    rows = vectors(random.Random(7), 30)
    df = spark.createDataFrame([(i, v, 1.0, "y") for i, v in rows], "vec_id bigint, embedding array<float>, x double, id string")
    assert sorted(map(tuple, C.centroid_clusters(df).collect()), key=str) == plain(rows)
