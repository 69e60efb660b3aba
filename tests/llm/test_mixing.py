import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quillmill.llm import mixing as M

from .helpers import DOCS, docs


def draw(key, mean, seed=M.SEED):
    chunks, n = max(1, math.ceil(mean / M.CHUNK_RATE)), 0
    for c in range(1, chunks + 1):
        u = int(hashlib.md5(f"{seed}|{key}|{c}".encode()).hexdigest()[:13], 16) / (1 << 52)
        p = cdf = math.exp(-mean / chunks)
        k = 0
        while u >= cdf and k < M.MAX_STEP:
            k += 1
            p *= mean / chunks / k
            cdf += p
        n += k
    return n


@pytest.mark.parametrize("mean", [0.0, 0.01, 0.7, 3.0, 40.0])
def test_draws_against_brute_force(spark, mean):
    got = spark.range(400).select("id", M.copies(F.col("id").cast("string"), F.lit(mean)).alias("n")).collect()
    assert all(r.n == (draw(r.id, mean) if mean else 0) for r in got)
    assert abs(sum(r.n for r in got) / 400 - mean) <= 4 * math.sqrt(max(mean, 1e-9) / 400) + 1e-9


def test_weights_and_totals(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 4 else "small") for i in range(8000)]
    out = M.mix(docs(spark, rows), {"big": 1.0, "small": 3.0}, total=4000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] - 3000) < 200 and abs(n["big"] - 1000) < 130


def test_copies_are_numbered_and_repeatable(spark):
    one = [tuple(r) for r in M.mix(docs(spark)).select("doc_id", "copy", "n_copies", "shuffle_key").collect()]
    two = [tuple(r) for r in M.mix(docs(spark).repartition(7)).select("doc_id", "copy", "n_copies", "shuffle_key").collect()]
    assert sorted(one, key=str) == sorted(two, key=str)
    assert all(0 <= c < n for _, c, n, _ in one)


def test_null_source_weight_zero_and_empty_table(spark):
    assert {r.source for r in M.mix(docs(spark), {None: 1.0}, total=400).select("source").distinct().collect()} <= {None}
    assert M.mix(docs(spark), {"nobody": 1.0}).count() == 0
    assert M.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert "extra" in M.mix(docs(spark).withColumn("extra", F.lit(1)).withColumn("copy", F.lit(9))).columns


def test_clashing_names(spark):
    df = docs(spark).withColumns({c: F.lit("mine") for c in ("__rate", "__source", "rate", "w")})
    out = M.mix(df)
    assert set(df.columns) <= set(out.columns) and all(r["__rate"] == r["__source"] == "mine" for r in out.collect())
