import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillmill.llm import quality_rules as Q

from .helpers import AWKWARD, DOCS, docs, stored


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    covered = {j for i, g in enumerate(win) if n[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_counts_against_brute_force(spark):
    rng = random.Random(9)
    rows = list(AWKWARD)
    for i in range(150):
        sep = rng.choice([" ", "\n", " \n", "\t", "  "])
        rows.append((100 + i, sep.join(rng.choice(["a", "b", "c#", "*&|", "é", "日本"]) for _ in range(rng.randrange(60))), "en", "s"))
    got = Q.features(docs(spark, rows).withColumn("n_words", F.lit("clash"))).collect()
    found = sorted((str(r.doc_id), r.text or "", (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
    assert found == sorted((str(i), t or "", counts(t)) for i, t, *_ in rows)


def test_junk_goes_and_clean_documents_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "ing", "er", "on"]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(30, 200))), "en", f"s{i % 3}") for i in range(600)]
    rows += [(1000 + i, " ".join(word() + "###$$$" for _ in range(60)), "en", f"s{i % 3}") for i in range(20)]
    out = {r.doc_id: r.kept for r in Q.quality_rules(docs(spark, rows)).collect()}
    assert sum(out[i] for i in range(600)) >= 598 and not any(out[1000 + i] for i in range(20))


def test_sketches_merge_to_the_whole(spark):
    rows = Q.features(docs(spark, [(i, "word " * (12 + i % 40) + "#" * (i % 9), "en", f"s{i % 2}") for i in range(300)]))
    parts = Q.sketches(rows.where("doc_id % 3 = 0"), ["lang"]).union(Q.sketches(rows.where("doc_id % 3 != 0"), ["lang"])).groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, Q.sketches(rows, ["lang"]).collect()))
    q = {r.metric: (r.q1, r.q3) for r in Q.quartiles(parts, ["lang"]).collect()}
    exact = sorted(r.v for r in rows.select(Q._metrics()["symbol_ppm"].alias("v")).collect())
    for got, want in zip(q["symbol_ppm"], (exact[74], exact[224]), strict=True):
        assert abs(got - want) <= 0.02 * want + 1


def test_awkward_rows_and_empty_table(spark):
    out = Q.quality_rules(docs(spark)).collect()
    assert len(out) == len(AWKWARD) and all(r.kept is not None for r in out)
    assert not any(r.kept for r in out if r.doc_id in (3, 4, 5, 8))
    assert Q.quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_filter_keeps_rows_as_they_are(spark, tmp_path):
    rows = [(i, f"word{i} " * 3 + " ".join(f"w{j * i % 53}x{j}" for j in range(30)), "en", "a") for i in range(20)] + AWKWARD
    df = stored(spark, tmp_path, docs(spark, rows)).withColumns({c: F.lit("mine") for c in ("n_lines", "__c", "__l", "n_words", "__quillmill_rid", "kept", "rid")})
    kept = Q.quality_filter(df)
    assert kept.columns == df.columns
    verdicts = Q.quality_rules(df).where("kept").collect()
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in verdicts) and verdicts
    assert all(r.n_lines == r["__c"] == "mine" for r in kept.collect())
