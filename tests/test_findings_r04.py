"""Cases of the fourth round's findings: each failed before."""

import os
import random
from collections import Counter

from quillmill.plans import registry

from .oracle import compare, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def documents(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "d"))
    part = next(f for f in os.listdir(tmp_path / "d") if f.endswith(".parquet"))
    os.rename(tmp_path / "d" / part, tmp_path / "documents.parquet")
    return str(tmp_path)


def test_roles_in_large_groups_and_short_texts(spark, tmp_path):
    long_ = " ".join(f"w{i}" for i in range(80))
    rows = [(i, long_) for i in range(3, 40)] + [(51 + i, f"{long_} tail{i}") for i in range(33)]  # one group with exams, over any cap
    rows += [(i, "six words make two shingles here") for i in (101, 102)]  # without an exam
    rows += [(i, "five words make one shingle") for i in (105, 106)] + [(200, "none of these is like them"), (201, None), (202, ""), (None, f"{long_} of no number"), (None, long_)]
    d = documents(spark, tmp_path, rows, "doc_id bigint, text string")
    out = QUERIES["d_cluster_roles_whole"](spark, d)
    assert compare(out, connect(d), SQL["d_cluster_roles_whole"]) is None
    role = lambda i, set_apart: "EXAM" if i % 5 == 0 else set_apart
    want = {(i, 3, role(i, "QUARANTINE")) for i, _ in rows if i is not None and i < 100} | {(101, 101, "TRAIN"), (102, 101, "TRAIN"), (105, 105, "EXAM"), (106, 105, "QUARANTINE")}
    assert {(r.id, r.cluster, r.final) for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()  # a cluster of any size is no single task's


def test_band_nearest_of_every_row(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice(["en", "de", None]), rng.choice([10, 10, 169, 170, 171, 330, 900, None])) for i in range(300)]
    rows += [(20, "en", 10), (20, "en", 170), (41, "de", 10), (41, "de", 10), (41, "de", 180), (None, "en", 10)]  # repeated numbers, and none
    rows += [(3_000_000_001, "xx", 5), (3_000_000_007, "xx", 6), (9, "xx", 7), (9_021, "yy", 5), (9_021, "yy", 9)]
    d = documents(spark, tmp_path, rows, "doc_id bigint, lang string, n_chars bigint")
    out = QUERIES["j_band_nearest_whole"](spark, d)
    assert compare(out, connect(d), SQL["j_band_nearest_whole"]) is None
    n = {r.doc_id: r.n for r in out.collect()}
    brute = Counter(q for q, l, x in rows for o, m, y in rows if None not in (q, o, l, x, y) and l == m and q != o and abs(x - y) <= 160)
    assert n == brute and len(n) > 10 * QUERIES["j_band_nearest"](spark, d).count()


def test_clusters_of_texts_with_common_lines_against_brute_force(spark):
    from quillmill.operators import similarity as S

    rng = random.Random(8)
    line = [f"c{i}" for i in range(14)]  # most texts have it, so sets that share it alone must not meet in all pairs
    texts = {}
    for i in range(400):
        old = texts[rng.randrange(i)] if i and rng.random() < 0.6 else None
        words = [w for w in old if rng.random() < 0.99] if old else [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 5, 6, 9, 30, 60, 120]))] + line * (rng.random() < 0.8)
        texts[i] = words
    sets = {i: {tuple(t[j : j + 5]) for j in range(len(t) - 4)} for i, t in texts.items()}
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {i: low if c == high else c for i, c in of.items()}
    many = Counter(of.values())
    want = {i: c for i, c in of.items() if many[c] > 1}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    assert any(S._hot_bits(df).first().bits)
    for shared in (1, 4):
        assert {r.id: r.cluster for r in S.whole_clusters(df, shared=shared).collect()} == want
