"""Classification metrics, votes and confidence over evaluation records, as grouped aggregations.

A record has expected (boolean), predicted (boolean, null for undecided), review (boolean: sent to a person),
expected_cwes and model_cwes (array of string) and risk (string). `by` groups the metrics; with none
they cover the whole table. Rates are null where their denominator is 0. Every metric is one aggregation: partial sums, then one small shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.verdicts import majority, ratio, wilson


def n_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def binary_counts(e: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates of decided records; reviewed ones are counted apart, undecided ones are invalid."""
    x, p, r = F.col("expected"), F.col("predicted"), F.coalesce(F.col("review"), F.lit(False))
    use = ~r & x.isNotNull() & p.isNotNull()
    out = e.groupBy(*(by or [])).agg(
        n_if(use & x & p).alias("tp"), n_if(use & ~x & ~p).alias("tn"), n_if(use & ~x & p).alias("fp"), n_if(use & x & ~p).alias("fn"),
        n_if(x.isNull() | (~r & p.isNull())).alias("invalid"), n_if(r & x).alias("review_vuln"), n_if(r & ~x).alias("review_safe"),
    )
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({"recall": F.round(ratio(tp, tp + fn), 4), "fpr": F.round(ratio(fp, fp + tn), 4), "accuracy": F.round(ratio(tp + tn, tp + tn + fp + fn), 4)})


def detection_metrics(e: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion counts with two denominators: valid records, and all with undecided ones as misses."""
    x, p = F.col("expected"), F.col("predicted")
    valid = x.isNotNull() & p.isNotNull()
    out = e.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), n_if(valid & x & p).alias("tp"), n_if(valid & ~x & ~p).alias("tn"), n_if(valid & ~x & p).alias("fp"), n_if(valid & x & ~p).alias("fn"),
        n_if(~valid).alias("invalid"), n_if(p.isNull() & x).alias("invalid_vuln"), n_if(p.isNull() & ~x).alias("invalid_safe"),
    )
    out = with_rates(out)
    return out.withColumns({"recall_all": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn") + F.col("invalid_vuln")), 4), "accuracy_all": F.round(ratio(F.col("tp") + F.col("tn"), F.col("total")), 4)})


def strict_anyhit(e: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records found with any expected class; found-as-safe records stay out of the denominator."""
    on = F.col("expected") & ~F.coalesce(F.col("review"), F.lit(False))
    hit = F.arrays_overlap("expected_cwes", "model_cwes")
    out = e.groupBy(*(by or [])).agg(
        n_if(on & F.col("predicted") & hit).alias("strict_tp"), n_if(on & F.col("predicted") & ~F.coalesce(hit, F.lit(False))).alias("cwe_mismatch"), n_if(on & F.col("predicted").isNull()).alias("parse_fail")
    )
    return out.withColumn("any_recall", F.round(ratio(F.col("strict_tp"), F.col("strict_tp") + F.col("cwe_mismatch") + F.col("parse_fail")), 4))


def strict_metrics(e: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Strict recall over found and missed records: tp + fn, not the denominator of strict_anyhit."""
    on = F.col("expected") & F.col("predicted").isNotNull() & ~F.coalesce(F.col("review"), F.lit(False))
    hit = F.coalesce(F.arrays_overlap("expected_cwes", "model_cwes"), F.lit(False))
    out = e.groupBy(*(by or [])).agg(n_if(on & F.col("predicted") & hit).alias("strict_tp"), n_if(on).alias("vuln_total"))
    return out.withColumn("strict_recall", F.round(ratio("strict_tp", "vuln_total"), 4))


def instance_metrics(e: DataFrame) -> DataFrame:
    """Recall over expected classes: micro, macro (mean over classes) and the share of records wholly covered."""
    on = e.where("expected AND NOT coalesce(review, false)")
    want = F.when(F.size("expected_cwes") > 0, F.col("expected_cwes")).otherwise(F.array(F.lit("?")))
    each = on.select(F.explode(want).alias("cwe"), "model_cwes").withColumn("hit", F.array_contains("model_cwes", F.col("cwe")))
    per = each.groupBy("cwe").agg(n_if(F.col("hit")).alias("h"), F.count(F.lit(1)).alias("n"))
    rates = per.agg(F.sum("n").alias("total"), F.sum("h").alias("hits"), F.round(F.avg(F.col("h") / F.col("n")), 4).alias("macro"))
    full = on.agg(F.round(ratio(n_if(F.col("predicted") & (F.size(F.array_except(want, "model_cwes")) == 0)), F.count(F.lit(1))), 4).alias("full_coverage"))
    # two rows of one record each, side by side
    return rates.withColumn("k", F.lit(1)).join(full.withColumn("k", F.lit(1)), "k").select("total", "hits", F.round(ratio("hits", "total"), 4).alias("micro"), "macro", "full_coverage")


def per_class_recall(e: DataFrame) -> DataFrame:
    on = e.where("expected AND NOT coalesce(review, false)")
    each = on.select(F.explode("expected_cwes").alias("cwe"), "model_cwes")
    out = each.groupBy("cwe").agg(n_if(F.array_contains("model_cwes", F.col("cwe"))).alias("hit"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("recall", F.round(ratio("hit", "total"), 4))


# fixed values: credits of a record by what was decided
CREDIT = {"hit": 1.0, "direction_only": 0.5, "review": 0.5, "safe_correct": 1.0}


def weighted_score(e: DataFrame, weights: dict[str, float], credit: dict[str, float] = CREDIT) -> DataFrame:
    """Risk-weighted score with partial credit."""
    w = F.lit(1.0)
    for k, v in weights.items():
        w = F.when(F.col("risk") == k, F.lit(v)).otherwise(w)
    n = F.greatest(F.size("expected_cwes"), F.lit(1)).cast("double")
    h = F.size(F.array_intersect("expected_cwes", "model_cwes")).cast("double")
    vuln = F.when(F.col("review"), credit["review"] * n).when(F.col("predicted"), credit["hit"] * h + credit["direction_only"] * (n - h)).otherwise(0.0)
    safe = F.when(F.col("review"), credit["review"]).when(~F.col("predicted"), credit["safe_correct"]).otherwise(0.0)
    on, off = F.col("expected"), ~F.col("expected")
    out = e.agg(F.sum(F.when(on, w * vuln)).alias("vn"), F.sum(F.when(on, w * n)).alias("vd"), F.sum(F.when(off, safe)).alias("sn"), n_if(off).cast("double").alias("sd"))
    return out.select(F.round(ratio(F.col("vn") + F.col("sn"), F.col("vd") + F.col("sd")), 4).alias("weighted"), F.round(ratio("vn", "vd"), 4).alias("vuln_coverage"), F.round(ratio("sn", "sd"), 4).alias("safe_score"))


def elapsed_stats(e: DataFrame, by: list[str] | None = None, value: str = "elapsed") -> DataFrame:
    """Mean, sample deviation (0 for one value), median, linear 95th percentile, extremes and sum."""
    v = F.col(value)
    return e.groupBy(*(by or [])).agg(
        F.count(v).alias("n"), F.round(F.avg(v), 2).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 2).alias("std"), F.round(F.percentile(v, F.lit(0.5)), 2).alias("median"),
        F.round(F.percentile(v, F.lit(0.95)), 2).alias("p95"), F.round(F.min(v), 2).alias("low"), F.round(F.max(v), 2).alias("high"), F.round(F.sum(v), 2).alias("total"),
    )


def vote(runs: DataFrame, key: str) -> DataFrame:
    """Votes per key: counts, majority with a quorum (tie is true), product rule (tie is null), agreement."""
    t, f = n_if(F.col("predicted")), n_if(~F.col("predicted"))
    out = runs.groupBy(key).agg(t.alias("t"), f.alias("f"), F.count(F.lit(1)).alias("n"), F.bool_or("expected").alias("expected"))
    valid = F.col("t") + F.col("f")
    return out.select(
        key, "expected", "t", "f", "n", majority("t", "f", "n").alias("majority"), F.when(F.col("t") != F.col("f"), F.col("t") > F.col("f")).alias("strict_majority"),
        F.when(valid == 0, "split").when(F.col("t") == F.col("f"), "split").when(F.least("t", "f") == 0, "unanimous").otherwise("majority").alias("consensus"),
        F.round(F.coalesce(ratio(F.greatest("t", "f"), valid), F.lit(0.0)), 4).alias("agreement"),
    )


def repeat_metrics(runs: DataFrame, key: str) -> DataFrame:
    """Confusion of the majority votes with Wilson intervals."""
    votes = vote(runs, key).select("expected", F.col("majority").alias("predicted"), F.lit(False).alias("review"))
    c = binary_counts(votes)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    a, r, f = wilson(tp + tn, tp + tn + fp + fn), wilson(tp, tp + fn), wilson(fp, fp + tn)
    return c.select("tp", "tn", "fp", "fn", "recall", "fpr", "accuracy", a["low"].alias("acc_low"), a["high"].alias("acc_high"), r["low"].alias("recall_low"), r["high"].alias("recall_high"), f["low"].alias("fpr_low"), f["high"].alias("fpr_high"))


def conformal_fit(votes: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Label-conditional quantiles of nonconformity: one row (q_vuln, q_safe), null for a label without rows.

    The level's place among n ordered scores is (1 - alpha)(n + 1) - 1, clamped, between two scores linear. Ranks
    come from a histogram of scores, as votes take few values: no sort of all rows in one task.
    """
    valid = F.col("t") + F.col("f")
    s_vuln = F.coalesce(1 - ratio("t", valid), F.lit(1.0))
    s_safe = F.coalesce(ratio("t", valid), F.lit(1.0))
    scores = votes.where("label IS NOT NULL").select("label", F.when(F.col("label"), s_vuln).otherwise(s_safe).alias("s"))
    hist = scores.groupBy("label", "s").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("label")
    at = hist.withColumns({"upto": F.sum("c").over(w.orderBy("s")), "n": F.sum("c").over(w)})
    idx = (1 - F.lit(alpha)) * (F.col("n") + 1) - 1
    lo = F.greatest(F.lit(0), F.least(F.floor(idx), F.col("n") - 1))
    hi = F.greatest(F.lit(0), F.least(F.ceil(idx), F.col("n") - 1))
    q = at.groupBy("label").agg(F.min(F.when(F.col("upto") > lo, F.col("s"))).alias("a"), F.min(F.when(F.col("upto") > hi, F.col("s"))).alias("b"), F.first(F.when(lo == hi, F.lit(0.0)).otherwise(idx - lo)).alias("frac"))
    value = F.col("a") * (1 - F.col("frac")) + F.col("b") * F.col("frac")
    return q.agg(F.max(F.when(F.col("label"), value)).alias("q_vuln"), F.max(F.when(~F.col("label"), value)).alias("q_safe"))


def conformal_predict(votes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """votes with decision: vulnerable, safe or uncertain. thresholds is the one row of conformal_fit."""
    valid = F.col("t") + F.col("f")
    in_v = F.coalesce(F.coalesce(1 - ratio("t", valid), F.lit(1.0)) <= F.col("q_vuln") + 1e-9, F.lit(False))
    in_s = F.coalesce(F.coalesce(ratio("t", valid), F.lit(1.0)) <= F.col("q_safe") + 1e-9, F.lit(False))
    one = F.when(F.col("t") > F.col("f"), "vulnerable").otherwise("safe")
    both = F.when(in_v & ~in_s, "vulnerable").when(in_s & ~in_v, "safe").otherwise("uncertain")
    row = thresholds.first()  # one row
    known = votes.withColumns({"q_vuln": F.lit(row["q_vuln"]).cast("double"), "q_safe": F.lit(row["q_safe"]).cast("double")})
    return known.withColumn("decision", F.when(F.col("n") <= 1, one).otherwise(both)).drop("q_vuln", "q_safe")


def paired_bootstrap(blocks: DataFrame, a: str, b: str, weight: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Confidence of the difference of two rates by resampling blocks: mean, low, high and two-sided p.

    blocks has one row per block with sums a, b and weight. Each block draws its number of repeats in a round from a Poisson
    distribution seeded by block and round, so that a round's sums are added where the blocks lie and
    only rounds x 3 numbers a task are shuffled.
    """
    import numpy as np
    import pandas as pd

    def run(parts):
        total = np.zeros((rounds, 3))
        for p in parts:
            x = p[[a, b, weight]].to_numpy(float)
            for i, k in enumerate(p["__key"].tolist()):
                total += np.random.default_rng([seed, k & 0xFFFFFFFFFFFFFFFF]).poisson(1.0, rounds)[:, None] * x[i]
        yield pd.DataFrame({"round": np.arange(rounds), "sa": total[:, 0], "sb": total[:, 1], "sw": total[:, 2]})

    keyed = blocks.withColumn("__key", F.xxhash64("block"))
    sums = keyed.mapInPandas(run, "round long, sa double, sb double, sw double").groupBy("round").agg(F.sum("sa").alias("sa"), F.sum("sb").alias("sb"), F.sum("sw").alias("sw"))
    d = sums.select((ratio("sa", "sw") - ratio("sb", "sw")).alias("d"))
    return d.agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))).alias("p"))


def hard_samples(records: DataFrame, slow: float) -> DataFrame:
    """A row for each kind of difficulty of a record: fn, fp, class_mismatch (a hit that shares no class) and slow; kinds overlap."""
    hit = F.col("expected") & F.col("predicted")
    kinds = [
        ("fn", F.col("expected") & ~F.col("predicted")), ("fp", ~F.col("expected") & F.col("predicted")),
        ("class_mismatch", hit & ~F.arrays_overlap("expected_cwes", "model_cwes")), ("slow", F.col("elapsed") > slow),
    ]
    return records.withColumn("kind", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in kinds]))))


def recall_monitor(checks: DataFrame) -> DataFrame:
    """One row from (layer, hit): the miss rate and its interval from the random layer only; the tiers' rates are hit rates."""
    n = lambda x, hit=False: F.count_if((F.col("layer") == x) & (F.col("hit") if hit else F.lit(True)))
    sums = checks.agg(n("random").alias("n_random"), n("random", True).alias("hits_random"), *[f(k).alias(f"__{w}_{k}") for k in ("tier_a", "tier_b") for w, f in (("n", n), ("h", lambda x: n(x, True)))])
    span = wilson("hits_random", "n_random")
    return sums.select(
        "n_random", "hits_random", F.round(ratio("hits_random", "n_random"), 4).alias("miss_rate"), span["low"].alias("low"), span["high"].alias("high"),
        *[F.round(ratio(f"__h_{k}", f"__n_{k}"), 4).alias(f"{k}_hit_rate") for k in ("tier_a", "tier_b")],
    )


def bootstrap_rates(rows: DataFrame, by: list[str], hit: Column, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """Rates of hits by group with a 95 % interval from resampling: by, n, hits, mean, low, high.

    The hits of a resample of n rows with h hits are a binomial draw of n trials at h / n, so each group is resampled from its two counts.
    Rows without a hit value don't count; a group without rows that do has null rates.
    """
    import numpy as np

    @F.pandas_udf("struct<mean: double, low: double, high: double>")
    def interval(n: pd.Series, hits: pd.Series) -> pd.DataFrame:
        out = []
        for total, h in zip(n, hits, strict=True):
            if not total:
                out.append((None, None, None))
                continue
            draws = np.sort(np.random.default_rng([seed, int(total), int(h)]).binomial(int(total), h / total, rounds)) / total
            out.append((h / total, draws[int(0.025 * rounds)], draws[int(0.975 * rounds)]))
        return pd.DataFrame(out, columns=["mean", "low", "high"], dtype=float)

    sums = rows.groupBy(*by).agg(F.count(hit).alias("n"), F.count_if(hit).alias("hits"))
    return sums.withColumn("__i", interval("n", "hits")).select(*by, "n", "hits", "__i.mean", "__i.low", "__i.high")
