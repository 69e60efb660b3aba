"""Cases of the third round's findings: each failed before."""

import datetime
import os
import random
from collections import Counter

from quillmill.plans import registry

from .oracle import compare, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def against_sql(spark, sf_dir, name):
    return compare(QUERIES[name](spark, str(sf_dir)), connect(str(sf_dir)), SQL[name])


def test_max_severity_weighs_value_and_number(spark, tmp_path):
    ts = datetime.datetime(2024, 1, 1)
    rows = [(5, ts, 1, "a", 99.01, "x"), (40_000, ts, 1, "a", 99.02, "x"), (7, ts, 2, "a", 1.0, "x"), (8, ts, 2, "a", 1.0, "x"), (9, ts, 3, "a", None, "x"), (10, ts, 4, "a", None, "x"), (11, ts, 4, "a", 2.0, "x")]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "e"))
    part = next(f for f in os.listdir(tmp_path / "e") if f.endswith(".parquet"))
    os.rename(tmp_path / "e" / part, tmp_path / "events.parquet")
    assert against_sql(spark, tmp_path, "r_max_severity") is None


def test_link_counts_against_brute_force_without_listing_pairs(spark):
    from quillmill.operators import similarity as S

    from .test_whole_pairs import brute

    rng = random.Random(9)
    sets = {i: {0} | {rng.randrange(1, 60) for _ in range(rng.randrange(12))} for i in range(90)}
    sets |= {100 + i: {0, 1, 2, 3} for i in range(70)}
    sets |= {200 + i: {0, *([1000 + i] if i % 2 else [])} for i in range(150)}  # a line that all have, beside one of their own
    df = spark.createDataFrame([(i, g) for i, x in sets.items() for g in x], "id bigint, g bigint")
    links = Counter(x for a, b, _ in brute(sets, 0.3, 0.45) for x in (a, b))
    got = {r.id: (r.rep, r.n, r.n_links) for r in S.link_counts(df, 0.3, 0.45).collect()}
    assert got == {i: (min(j for j in sets if sets[j] == x), len(x), links[i]) for i, x in sets.items()}


def test_line_links_against_sql(spark):
    assert against_sql(spark, "/root/testdata/sf0.001", "d_line_set_whole") is None


def test_shingles_are_shuffled_once(spark):
    from quillmill.operators import similarity as S

    grams = spark.createDataFrame([(1, 5), (2, 5)], "id bigint, g bigint")
    plan = S.candidate_pairs(grams)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(g#") == 1


def test_near_pairs_of_different_sizes_and_hot_shingles(spark):
    from quillmill.operators import similarity as S

    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = {i: base[: 60 - i] + [f"x{i}_{j}" for j in range(i % 3)] for i in range(20)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    sets = {i: {tuple(t[j : j + 5]) for j in range(len(t) - 4)} for i, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in S.near_duplicates(df).collect()} == want
    held = spark.createDataFrame([(i, hash(g)) for i, x in sets.items() for g in x], "id bigint, g bigint")
    assert {(r.a, r.b) for r in S.whole_pairs(held, S.set_classes(held), 0.8).collect()} == want


def test_band_nearest_of_many_rows_of_few_lengths_and_repeated_numbers(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["en", "de", None]), rng.choice([10, 10, 169, 170, 171, 330, 900, None])) for i in range(400)]
    rows += [(20, "en", 10), (20, "en", 170), (40, "de", 10), (40, "de", 10), (9_000, "xx", 5), (9_020, "yy", 5), (9_020, "yy", 9), (9_001, "yy", 165)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "d"))
    part = next(f for f in os.listdir(tmp_path / "d") if f.endswith(".parquet"))
    os.rename(tmp_path / "d" / part, tmp_path / "documents.parquet")
    assert against_sql(spark, tmp_path, "j_band_nearest") is None
    df = QUERIES["j_band_nearest"](spark, str(tmp_path))
    assert "rows" in df._jdf.queryExecution().optimizedPlan().toString()  # rows are counted by length before lengths meet


def test_cells_are_asked_until_the_recall_is_reached(spark, tmp_path):
    import numpy as np

    from quillmill.operators import vector_store as VS
    from quillmill.operators import vectors as N

    rows = [(i, v) for i, v in enumerate(np.random.default_rng(3).normal(size=(1200, 48)).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    store = VS.VectorStore.create(spark, str(tmp_path / "s"), VS.fit_centers(df, cells=24))
    store.add(df)
    q = df.where("vec_id % 20 = 0")
    exact = N.knn(q, df, 10)
    few, enough = VS.recall(store.search(q, 10, 4), exact).first()["recall"], VS.recall(store.search(q, 10, store.tune(q, 10, least=4)), exact).first()["recall"]
    assert few < 0.9 <= enough


def test_class_labels_lower_a_text_once(spark):
    from quillmill.functions import labels as L

    df = spark.createDataFrame([("Weak Hash",), ("plain",), (None,)], "text string")
    out = df.select(L.class_label("text").alias("c"))
    assert [r.c for r in out.collect()] == ["CWE-327 Use of a Broken or Risky Cryptographic Algorithm", "plain", "none"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2


def test_texts_of_a_batch_become_objects_in_slices(spark):
    import pyarrow as pa

    from quillmill.functions import text as T

    n, seen = 3 * T.SLICE + 5, []
    got = T.by_slices(lambda a, b: seen.append(a) or (None if a is None else a + b), pa.string(), pa.array([None, *["x"] * (n - 1)]), pa.array([str(i) for i in range(n)]))
    assert got.to_pylist() == [None, *[f"x{i}" for i in range(1, n)]] and len(seen) == n
    assert T.by_slices(str, pa.string(), pa.array([], pa.string())).to_pylist() == []


def programs(spark, tmp_path):
    text = "def a(x) { return x + 'on'; }\nfunction go(u) {\nvar v = u + \"on\";\nopen(v);\n}\nvar w = escape(location.hash);\ngo(a(location.search)); open(w);"
    spark.createDataFrame([(i, text) for i in range(30)] + [(99, "f(1)")], "k bigint, code string").write.parquet(str(tmp_path / "code"))
    return spark.read.parquet(str(tmp_path / "code"))


def test_flows_broadcast_rules_only(spark, tmp_path, monkeypatch):
    from quillmill.functions import lexer as L
    from quillmill.operators import code as C

    plans, write = [], C._written
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "_written", lambda df: plans.append(plan_of(df)) or write(df))
    df = programs(spark, tmp_path)
    out = C.flows(L.tokens(df, "k", "code"), "k", C.flow_rules(spark))
    plans.append(plan_of(out))
    assert {(r.k, r.sink, r.label) for r in out.collect()} == {(i, "open", "Path Traversal") for i in range(30)}
    for plan in plans:
        assert plan.count("BroadcastExchange") <= plan.count("ExistingRDD")


def test_texts_are_read_once_for_origins(spark, tmp_path):
    from quillmill.functions import lexer as L
    from quillmill.operators import code as C

    df = programs(spark, tmp_path)
    plan = C.argument_origins(df, L.tokens(df, "k", "code"), "k", "code")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "BroadcastExchange" not in plan


def test_tokens_of_short_texts_share_a_batch():
    import pyarrow as pa

    from quillmill.functions import lexer as L

    b = pa.RecordBatch.from_arrays([pa.array(range(53)), pa.array(["f(1)"] * 50 + [None, "x + 1\n" * 20_000, "g()"])], names=["k", "code"])
    out = list(L._rows(None, False)(iter([b])))
    assert max(x.num_rows for x in out) <= L._MOST and len(out) < 8
    assert [(k, s) for x in out for k, s in zip(x["k"].to_pylist(), x["seq"].to_pylist(), strict=True)] == [(i, r["seq"]) for i, t in enumerate(b["code"].to_pylist()) for r in L.tokens_of(t)]
