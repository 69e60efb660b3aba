import random

import numpy as np
import pytest

from quillmill.operators import vector_store as V
from quillmill.operators.vectors import knn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(many, seed, dims=8):
    rng = random.Random(seed)
    spots = [[rng.gauss(0, 2) for _ in range(dims)] for _ in range(12)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.7))) for x in rng.choice(spots)], rng.randrange(3)) for i in range(many)]


def plain(rows, queries, k, where=None):
    out = set()
    for q, v, _ in queries:
        d = sorted((float(((np.array(v) - np.array(x)) ** 2).sum()), i) for i, x, m in rows if where is None or m == where)[:k]
        out |= {(q, i, r) for r, (_, i) in enumerate(d, 1)}
    return out


def found(df):
    return {(r.query_id, r.id, r.rank) for r in df.collect()}


def test_upserts_deletions_and_search(spark, tmp_path):
    rows = vectors(600, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    store = V.VectorStore.create(spark, str(tmp_path / "s"), V.fit_centers(df, cells=10, sample=300))
    assert store.count() == 0 and store.search(df.limit(3), 2).count() == 0
    store.add(df, meta=("label",))
    assert store.count() == 600
    with pytest.raises(ValueError):
        store.add(df.where("vec_id = 5"))
    queries = [r for r in rows if r[0] % 25 == 0]
    q = spark.createDataFrame(queries, SCHEMA)
    assert found(store.search(q, 5, probes=10)) == plain(rows, queries, 5)
    moved = [(i, [-x for x in v], 1) for i, v, _ in rows if i % 10 == 3] + [(9999, rows[0][1], 2), (None, rows[0][1], 2), (1, None, 0)]
    store.upsert(spark.createDataFrame(moved, SCHEMA), meta=("label",))
    store.delete(spark.createDataFrame([(i,) for i in range(0, 600, 7)] + [(123456,)], "vec_id bigint"))
    now = {i: (i, v, m) for i, v, m in rows} | {i: (i, v, m) for i, v, m in moved if i is not None and v is not None}
    now = [r for i, r in now.items() if i % 7 or i >= 600]
    assert store.count() == len(now)
    assert found(store.search(q, 5, probes=10)) == plain(now, queries, 5)
    assert found(store.search(q, 4, probes=10, where={"label": "1"})) == plain(now, queries, 4, 1)
    store.upsert(spark.createDataFrame([(7, rows[7][1], 0)], SCHEMA))  # a deleted id comes back
    assert store.count() == len(now) + 1


def test_recall_of_some_cells(spark, tmp_path):
    df = spark.createDataFrame(vectors(2000, 2), SCHEMA)
    store = V.VectorStore.create(spark, str(tmp_path / "s"), V.fit_centers(df, cells=16))
    store.add(df)
    q = df.where("vec_id % 20 = 0")
    got = V.recall(store.search(q, 10, probes=4), knn(q, df, 10)).first()
    assert got.n_queries == 100 and got.n_exact == 1000 and got.recall >= 0.9


def test_no_and_one_vector(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)
    store = V.VectorStore.create(spark, str(tmp_path / "a"), V.fit_centers(one))
    store.add(one)
    store.upsert(none)
    assert found(store.search(one, 3)) == {(1, 1, 1)} and store.search(none, 3).count() == 0
