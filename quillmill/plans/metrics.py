"""Queries of the metrics, votes and statistics. Records are made from documents and labels by fixed expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts as V
from ..operators import metrics as M
from .registry import query, table

# the same expressions for Spark and SQL
_COLS = [
    "d.doc_id", "d.lang", "d.source", "toxic = 1 AS expected",
    "CASE WHEN d.doc_id % 13 = 0 OR d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 5 = 0 THEN toxic <> 1 ELSE toxic = 1 END AS predicted",
    "d.doc_id % 13 = 0 AS review",
    "CASE d.doc_id % 3 WHEN 0 THEN 'CWE-22 CWE-89' WHEN 1 THEN 'CWE-79' ELSE '' END AS want",
    "CASE d.doc_id % 4 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-79' WHEN 2 THEN 'CWE-22 CWE-78' ELSE '' END AS got",
    "CASE d.doc_id % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' ELSE NULL END AS risk",
    "CAST(d.doc_id % 97 AS DOUBLE) / 7 AS elapsed",
]
E_SQL = f"""e0 AS (SELECT {', '.join(_COLS)} FROM documents d JOIN labels l USING (doc_id)),
e AS (SELECT *, list_filter(string_split(want, ' '), lambda x: x <> '') AS expected_cwes, list_filter(string_split(got, ' '), lambda x: x <> '') AS model_cwes FROM e0)"""
WITH = f"WITH {E_SQL}"


def records(spark, d):
    j = table(spark, d, "documents").alias("d").join(table(spark, d, "labels").alias("l"), "doc_id")
    e = j.selectExpr(*_COLS)
    split = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    return e.withColumns({"expected_cwes": split("want"), "model_cwes": split("got")})


_USE = "NOT review AND expected IS NOT NULL AND predicted IS NOT NULL"
_RATES = "round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS recall, round(fp::DOUBLE / nullif(fp + tn, 0), 4) AS fpr, round((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 4) AS accuracy"


def _binary_sql(by: str = "") -> str:
    return f"""{WITH} SELECT *, {_RATES} FROM (SELECT {by + ',' if by else ''} count(*) FILTER ({_USE} AND expected AND predicted) AS tp, count(*) FILTER ({_USE} AND NOT expected AND NOT predicted) AS tn, count(*) FILTER ({_USE} AND NOT expected AND predicted) AS fp, count(*) FILTER ({_USE} AND expected AND NOT predicted) AS fn,
  count(*) FILTER (expected IS NULL OR (NOT review AND predicted IS NULL)) AS invalid, count(*) FILTER (review AND expected) AS review_vuln, count(*) FILTER (review AND NOT expected) AS review_safe FROM e {'GROUP BY ' + by if by else ''})"""


@query("m_binary_counts", _binary_sql())
def _(spark, d):
    return M.binary_counts(records(spark, d))


@query("m_by_language", _binary_sql("lang"))
def _(spark, d):
    return M.binary_counts(records(spark, d), ["lang"])


@query("m_by_source", _binary_sql("source"))
def _(spark, d):
    return M.binary_counts(records(spark, d), ["source"])


_V = "expected IS NOT NULL AND predicted IS NOT NULL"


@query("m_detection", f"""{WITH} SELECT *, {_RATES}, round(tp::DOUBLE / nullif(tp + fn + invalid_vuln, 0), 4) AS recall_all, round((tp + tn)::DOUBLE / nullif(total, 0), 4) AS accuracy_all FROM (
SELECT count(*) AS total, count(*) FILTER ({_V} AND expected AND predicted) AS tp, count(*) FILTER ({_V} AND NOT expected AND NOT predicted) AS tn, count(*) FILTER ({_V} AND NOT expected AND predicted) AS fp, count(*) FILTER ({_V} AND expected AND NOT predicted) AS fn, count(*) FILTER (NOT ({_V})) AS invalid, count(*) FILTER (predicted IS NULL AND expected) AS invalid_vuln, count(*) FILTER (predicted IS NULL AND NOT expected) AS invalid_safe FROM e)""")
def _(spark, d):
    return M.detection_metrics(records(spark, d))


@query("m_strict_anyhit", f"""{WITH} SELECT *, round(strict_tp::DOUBLE / nullif(strict_tp + cwe_mismatch + parse_fail, 0), 4) AS any_recall FROM (
SELECT count(*) FILTER (expected AND NOT review AND predicted AND list_has_any(expected_cwes, model_cwes)) AS strict_tp, count(*) FILTER (expected AND NOT review AND predicted AND NOT list_has_any(expected_cwes, model_cwes)) AS cwe_mismatch, count(*) FILTER (expected AND NOT review AND predicted IS NULL) AS parse_fail FROM e)""")
def _(spark, d):
    return M.strict_anyhit(records(spark, d))


@query("m_strict_recall", f"""{WITH} SELECT *, round(strict_tp::DOUBLE / nullif(vuln_total, 0), 4) AS strict_recall FROM (
SELECT count(*) FILTER (expected AND NOT review AND predicted AND list_has_any(expected_cwes, model_cwes)) AS strict_tp, count(*) FILTER (expected AND NOT review AND predicted IS NOT NULL) AS vuln_total FROM e)""")
def _(spark, d):
    return M.strict_metrics(records(spark, d))


@query("m_instance", f"""{WITH}, x AS (SELECT *, CASE WHEN len(expected_cwes) > 0 THEN expected_cwes ELSE ['?'] END AS want2 FROM e WHERE expected AND NOT review),
u AS (SELECT unnest(want2) AS cwe, model_cwes FROM x), p AS (SELECT cwe, count(*) FILTER (list_contains(model_cwes, cwe)) AS h, count(*) AS n FROM u GROUP BY cwe)
SELECT sum(n)::BIGINT AS total, sum(h)::BIGINT AS hits, round(sum(h)::DOUBLE / sum(n), 4) AS micro, round(avg(h::DOUBLE / n), 4) AS macro, (SELECT round(count(*) FILTER (predicted AND list_has_all(model_cwes, want2))::DOUBLE / count(*), 4) FROM x) AS full_coverage FROM p""")
def _(spark, d):
    return M.instance_metrics(records(spark, d))


@query("m_per_class", f"""{WITH} SELECT *, round(hit::DOUBLE / total, 4) AS recall FROM (SELECT cwe, count(*) FILTER (list_contains(model_cwes, cwe)) AS hit, count(*) AS total FROM (SELECT unnest(expected_cwes) AS cwe, model_cwes FROM e WHERE expected AND NOT review) GROUP BY cwe)""")
def _(spark, d):
    return M.per_class_recall(records(spark, d))


# fixed values: weights of risk levels
RISK_WEIGHTS = {"Critical": 1.0, "High": 0.8, "Medium": 0.5, "Low": 0.2}


@query("m_weighted", f"""{WITH}, w AS (SELECT *, CASE risk WHEN 'Critical' THEN 1.0 WHEN 'High' THEN 0.8 WHEN 'Medium' THEN 0.5 WHEN 'Low' THEN 0.2 ELSE 1.0 END::DOUBLE AS w, greatest(len(expected_cwes), 1)::DOUBLE AS n, len(list_intersect(expected_cwes, model_cwes))::DOUBLE AS h FROM e),
s AS (SELECT sum(w * CASE WHEN review THEN 0.5 * n WHEN predicted THEN h + 0.5 * (n - h) ELSE 0 END) FILTER (expected)::DOUBLE AS vn, sum(w * n) FILTER (expected)::DOUBLE AS vd, sum(CASE WHEN review THEN 0.5 WHEN NOT predicted THEN 1 ELSE 0 END) FILTER (NOT expected)::DOUBLE AS sn, count(*) FILTER (NOT expected)::DOUBLE AS sd FROM w)
SELECT round((vn + sn) / nullif(vd + sd, 0), 4) AS weighted, round(vn / nullif(vd, 0), 4) AS vuln_coverage, round(sn / nullif(sd, 0), 4) AS safe_score FROM s""")
def _(spark, d):
    return M.weighted_score(records(spark, d), RISK_WEIGHTS)


@query("m_elapsed", f"""{WITH} SELECT lang, count(elapsed) AS n, round(avg(elapsed), 2) AS mean, round(coalesce(stddev_samp(elapsed), 0), 2) AS std, round(quantile_cont(elapsed, 0.5), 2) AS median, round(quantile_cont(elapsed, 0.95), 2) AS p95, round(min(elapsed), 2) AS low, round(max(elapsed), 2) AS high, round(sum(elapsed), 2) AS total FROM e GROUP BY lang""")
def _(spark, d):
    return M.elapsed_stats(records(spark, d), ["lang"])


_RUNS = "SELECT doc_id, expected, CASE WHEN (doc_id + r) % 7 = 0 THEN NULL WHEN (doc_id * 3 + r) % 4 = 0 THEN NOT expected ELSE expected END AS predicted, r FROM (SELECT doc_id, toxic = 1 AS expected FROM labels) x, (SELECT unnest([0, 1, 2]) AS r) y"


def runs(spark, d):
    x = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("expected"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("r"))
    return x.withColumn("predicted", F.expr("CASE WHEN (doc_id + r) % 7 = 0 THEN NULL WHEN (doc_id * 3 + r) % 4 = 0 THEN NOT expected ELSE expected END"))


_VOTE = f"""runs AS ({_RUNS}), v AS (SELECT doc_id, bool_or(expected) AS expected, count(*) FILTER (predicted) AS t, count(*) FILTER (NOT predicted) AS f, count(*) AS n FROM runs GROUP BY doc_id),
votes AS (SELECT doc_id, expected, t, f, n, CASE WHEN t + f > 0 AND (t + f) * 2 > n THEN t * 2 >= t + f END AS majority, CASE WHEN t <> f THEN t > f END AS strict_majority,
  CASE WHEN t = f THEN 'split' WHEN least(t, f) = 0 THEN 'unanimous' ELSE 'majority' END AS consensus, round(coalesce(greatest(t, f)::DOUBLE / nullif(t + f, 0), 0), 4) AS agreement FROM v)"""


@query("m_votes", f"WITH {_VOTE} SELECT * FROM votes")
def _(spark, d):
    return M.vote(runs(spark, d), "doc_id")


def _wilson_sql(k: str, n: str, low: str, high: str) -> str:
    p, z = f"(({k})::DOUBLE / nullif({n}, 0))", "1.96::DOUBLE"
    mid = f"(({p} + {z} * {z} / (2 * ({n}))) / (1 + {z} * {z} / ({n})))"
    margin = f"({z} * sqrt({p} * (1 - {p}) / ({n}) + {z} * {z} / (4 * ({n})::DOUBLE * ({n}))) / (1 + {z} * {z} / ({n})))"
    return f"CASE WHEN ({n}) > 0 THEN round(greatest(0.0, {mid} - {margin}), 4) END AS {low}, CASE WHEN ({n}) > 0 THEN round(least(1.0, {mid} + {margin}), 4) END AS {high}"


@query("m_repeat", f"""WITH {_VOTE}, c AS (SELECT count(*) FILTER (expected AND majority) AS tp, count(*) FILTER (NOT expected AND NOT majority) AS tn, count(*) FILTER (NOT expected AND majority) AS fp, count(*) FILTER (expected AND NOT majority) AS fn FROM votes)
SELECT tp, tn, fp, fn, {_RATES}, {_wilson_sql('tp + tn', 'tp + tn + fp + fn', 'acc_low', 'acc_high')}, {_wilson_sql('tp', 'tp + fn', 'recall_low', 'recall_high')}, {_wilson_sql('fp', 'fp + tn', 'fpr_low', 'fpr_high')} FROM c""")
def _(spark, d):
    return M.repeat_metrics(runs(spark, d), "doc_id")


@query("m_multi_seed", f"""WITH runs AS ({_RUNS}), s AS (SELECT r, count(*) FILTER (expected AND predicted)::DOUBLE / nullif(count(*) FILTER (expected AND predicted IS NOT NULL), 0) AS recall, count(*) FILTER (expected = predicted)::DOUBLE / count(*) FILTER (predicted IS NOT NULL) AS accuracy FROM runs GROUP BY r)
SELECT round(avg(recall), 4) AS recall_mean, round(stddev_samp(recall), 4) AS recall_std, round(avg(accuracy), 4) AS accuracy_mean, round(stddev_samp(accuracy), 4) AS accuracy_std FROM s""")
def _(spark, d):
    """Metrics of each seed, then mean and deviation over seeds."""
    c = M.with_rates(runs(spark, d).groupBy("r").agg(*[M.n_if(F.expr(x)).alias(n) for n, x in (("tp", "expected AND predicted"), ("tn", "NOT expected AND NOT predicted"), ("fp", "NOT expected AND predicted"), ("fn", "expected AND NOT predicted"))]))
    recall, acc = V.ratio(F.col("tp"), F.col("tp") + F.col("fn")), V.ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return c.agg(F.round(F.avg(recall), 4).alias("recall_mean"), F.round(F.stddev_samp(recall), 4).alias("recall_std"), F.round(F.avg(acc), 4).alias("accuracy_mean"), F.round(F.stddev_samp(acc), 4).alias("accuracy_std"))


@query("m_outcome_crosstab", f"""{WITH} SELECT lang, count(*) FILTER (o = 'TP') AS tp, count(*) FILTER (o = 'FP') AS fp, count(*) FILTER (o = 'FN') AS fn, count(*) FILTER (o = 'TN') AS tn, count(*) FILTER (o = 'parse_fail') AS parse_fail FROM (
SELECT lang, CASE WHEN predicted IS NULL THEN 'parse_fail' WHEN expected AND predicted THEN 'TP' WHEN expected THEN 'FN' WHEN predicted THEN 'FP' ELSE 'TN' END AS o FROM e) GROUP BY lang""")
def _(spark, d):
    o = F.expr("CASE WHEN predicted IS NULL THEN 'parse_fail' WHEN expected AND predicted THEN 'tp' WHEN expected THEN 'fn' WHEN predicted THEN 'fp' ELSE 'tn' END")
    names = ["tp", "fp", "fn", "tn", "parse_fail"]
    return records(spark, d).withColumn("o", o).groupBy("lang").pivot("o", names).agg(F.count(F.lit(1))).na.fill(0, names)


@query("m_class_confusion", f"""{WITH} SELECT t, p, count(*) AS n FROM (SELECT coalesce(expected_cwes[1], 'none') AS t, coalesce(model_cwes[1], 'none') AS p FROM e) GROUP BY t, p""")
def _(spark, d):
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit("none"))
    return records(spark, d).select(first("expected_cwes").alias("t"), first("model_cwes").alias("p")).groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))


@query("m_percentiles", """
WITH x AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n_chars) FILTER (i = floor(0.9::DOUBLE * (n - 1))) AS nearest, max(n_chars) FILTER (i = least(n - 1, floor(0.9::DOUBLE * n))) AS by_count, max(n_chars) FILTER (i = greatest(0, floor(0.9::DOUBLE * (n - 1) + 0.5) - 1)) AS rounded,
  round((SELECT quantile_cont(n_chars::DOUBLE, 0.9) FROM documents d WHERE d.lang = x.lang), 3) AS linear, max(n_chars) FILTER (i = greatest(0, least(n - 1, ceil(0.9::DOUBLE * (n + 1)) - 1))) AS conformal FROM x GROUP BY lang""")
def _(spark, d):
    """Five definitions of the 90th percentile, from one histogram per language."""
    from pyspark.sql import Window

    hist = table(spark, d, "documents").groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("lang")
    at = hist.withColumns({"upto": F.sum("c").over(w.orderBy("n_chars")), "n": F.sum("c").over(w)})
    q = F.lit(0.9)
    pick = lambda i: F.min(F.when(F.col("upto") > i, F.col("n_chars")))
    n = F.col("n")
    lo = F.floor(q * (n - 1))
    out = at.groupBy("lang").agg(
        pick(lo).alias("nearest"), pick(F.least(n - 1, F.floor(q * n))).alias("by_count"), pick(F.greatest(F.lit(0), F.floor(q * (n - 1) + 0.5) - 1)).alias("rounded"),
        pick(lo).alias("a"), pick(F.ceil(q * (n - 1))).alias("b"), F.first(q * (n - 1) - lo).alias("frac"),
        pick(F.greatest(F.lit(0), F.least(n - 1, F.ceil(q * (n + 1)) - 1))).alias("conformal"),
    )
    return out.select("lang", "nearest", "by_count", "rounded", F.round(F.col("a") * (1 - F.col("frac")) + F.col("b") * F.col("frac"), 3).alias("linear"), "conformal")


@query("m_length_histogram", "SELECT n_chars // 500 AS bin, count(*) AS n, count(*) FILTER (n_chars > 2048) AS over_2048, count(*) FILTER (n_chars > 8192) AS over_8192 FROM documents GROUP BY bin")
def _(spark, d):
    return table(spark, d, "documents").groupBy(F.floor(F.col("n_chars") / 500).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2048).alias("over_2048"), F.count_if(F.col("n_chars") > 8192).alias("over_8192"))


@query("m_style_by_source", """
WITH s AS (SELECT source, median(n_chars::DOUBLE) AS med, quantile_cont(n_chars::DOUBLE, 0.9) AS p90 FROM documents GROUP BY source), b AS (SELECT median(n_chars::DOUBLE) AS base FROM documents)
SELECT source, round(med, 2) AS med, round(p90, 2) AS p90, round(med / base, 4) AS ratio FROM s, b""")
def _(spark, d):
    """Median lengths per source against that of all documents, each source counted once more under a total group."""
    docs = table(spark, d, "documents").select("source", F.col("n_chars").cast("double").alias("n"))
    s = docs.groupBy("source").agg(F.percentile("n", F.lit(0.5)).alias("med"), F.percentile("n", F.lit(0.9)).alias("p90"))
    base = docs.agg(F.percentile("n", F.lit(0.5)).alias("base")).first()["base"]
    return s.select("source", F.round("med", 2).alias("med"), F.round("p90", 2).alias("p90"), F.round(F.col("med") / F.lit(base), 4).alias("ratio"))


TERMS = ["the", "stupid", "worthless", "que", "nicht", "zebra"]


@query("m_keyword_coverage", f"""SELECT term, sum((length(text) - length(replace(text, term, ''))) // length(term))::BIGINT AS occurrences, count(*) FILTER (contains(text, term)) AS n_docs FROM documents, (SELECT unnest({TERMS}) AS term) GROUP BY term""")
def _(spark, d):
    """Occurrences of terms, those without any included; the terms ride along each row, no join."""
    x = table(spark, d, "documents").select("text", F.explode(F.array(*[F.lit(t) for t in TERMS])).alias("term"))
    n = ((F.length("text") - F.length(F.replace("text", F.col("term"), F.lit("")))) / F.length("term")).cast("long")
    return x.groupBy("term").agg(F.sum(n).alias("occurrences"), F.count_if(F.contains("text", F.col("term"))).alias("n_docs"))


@query("m_thin_slices", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source HAVING count(*) <= 3")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).where("n <= 3")


@query("m_dup_report", "SELECT lang, count(*) AS groups, sum(n - 1)::BIGINT AS redundant, max(n) AS largest FROM (SELECT lang, md5(text) AS h, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1) GROUP BY lang")
def _(spark, d):
    g = table(spark, d, "documents").groupBy("lang", F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("redundant"), F.max("n").alias("largest"))


@query("m_contradictions", """
SELECT md5(text) AS h, count(*) AS n, count(DISTINCT coalesce(toxic::VARCHAR, 'null')) AS n_labels FROM documents LEFT JOIN labels USING (doc_id) GROUP BY h HAVING count(DISTINCT coalesce(toxic::VARCHAR, 'null')) > 1""")
def _(spark, d):
    """Equal texts with different labels; no label counts as one."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.md5(F.col("text").cast("binary")).alias("h"), F.coalesce(F.col("toxic").cast("string"), F.lit("null")).alias("y"))
    return j.groupBy("h", "y").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_labels")).where("n_labels > 1")


@query("m_consensus", """
SELECT doc_id, a = b AND b = c AS unanimous, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b END AS agreed, CASE WHEN a = b AND b = c THEN CASE WHEN a = 1 THEN 'accept' ELSE 'reject' END ELSE 'manual' END AS verdict
FROM (SELECT doc_id, toxic AS a, quality AS b, (doc_id % 2)::INT AS c FROM labels)""")
def _(spark, d):
    """Three reviewers: unanimity, two-of-three value, and an arbiter that passes only unanimity."""
    x = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("a"), F.col("quality").alias("b"), (F.col("doc_id") % 2).cast("int").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    same = (a == b) & (b == c)
    return x.select("doc_id", same.alias("unanimous"), F.when((a == b) | (a == c), a).when(b == c, b).alias("agreed"), F.when(same, F.when(a == 1, "accept").otherwise("reject")).otherwise("manual").alias("verdict"))


@query("m_generator_weights", f"""{WITH} SELECT source, accuracy, CASE WHEN accuracy >= 0.85 THEN 1.0 WHEN accuracy >= 0.7 THEN 0.8 ELSE 0.5 END::DOUBLE AS weight FROM (SELECT source, round(count(*) FILTER (expected = predicted)::DOUBLE / nullif(count(*) FILTER (predicted IS NOT NULL), 0), 4) AS accuracy FROM e GROUP BY source)""")
def _(spark, d):
    acc = F.round(V.ratio(M.n_if(F.expr("expected = predicted")), F.count("predicted")), 4)
    g = records(spark, d).groupBy("source").agg(acc.alias("accuracy"))
    return g.withColumn("weight", F.when(F.col("accuracy") >= 0.85, 1.0).when(F.col("accuracy") >= 0.7, 0.8).otherwise(0.5))


@query("m_reconcile", """
SELECT coalesce(b.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'extra' WHEN r.n > 1 THEN 'repeated' ELSE 'fine' END AS state
FROM (SELECT doc_id FROM documents) b FULL JOIN (SELECT doc_id * 2 AS doc_id, count(*) AS n FROM labels GROUP BY 1) r ON b.doc_id = r.doc_id""")
def _(spark, d):
    """A batch's ids against those reviewed: missing, extra, repeated."""
    r = table(spark, d, "labels").groupBy((F.col("doc_id") * 2).alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, d, "documents").select("doc_id", F.lit(True).alias("here")).join(r, "doc_id", "full")
    return j.select("doc_id", F.when(F.col("n").isNull(), "missing").when(F.col("here").isNull(), "extra").when(F.col("n") > 1, "repeated").otherwise("fine").alias("state"))


@query("m_adjudication", f"""WITH {_VOTE} SELECT doc_id, t > f AS confirmed, round(coalesce(greatest(t, f)::DOUBLE / nullif(t + f, 0), 0), 4) AS confidence, n - t - f AS invalid FROM votes""")
def _(spark, d):
    """Confirmed by more true than false votes; confidence over valid votes."""
    v = M.vote(runs(spark, d), "doc_id")
    return v.select("doc_id", (F.col("t") > F.col("f")).alias("confirmed"), F.col("agreement").alias("confidence"), (F.col("n") - F.col("t") - F.col("f")).alias("invalid"))


@query("m_group_verdict", f"""WITH {_VOTE} SELECT source, CASE WHEN bool_or(t > f AND agreement >= 0.8) THEN true WHEN sum(t + f) = 0 THEN NULL WHEN bool_and(t < f) THEN false ELSE NULL END AS verdict, max(agreement) AS top_confidence FROM votes JOIN documents USING (doc_id) GROUP BY source""")
def _(spark, d):
    """A group is true with any strong true finding, false if all findings are, else undecided."""
    v = M.vote(runs(spark, d), "doc_id").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    g = v.groupBy("source").agg(F.bool_or(F.expr("t > f AND agreement >= 0.8")).alias("strong"), F.sum(F.expr("t + f")).alias("valid"), F.bool_and(F.expr("t < f")).alias("safe"), F.max("agreement").alias("top_confidence"))
    return g.select("source", F.when(F.col("strong"), True).when(F.col("valid") == 0, F.lit(None)).when(F.col("safe"), False).alias("verdict"), "top_confidence")


@query("m_type_vote", """
WITH c AS (SELECT user_id, event_type, count(*) AS n, max(value) AS sev FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, sev DESC, event_type DESC) AS rn FROM c) WHERE rn = 1""")
def _(spark, d):
    """The most frequent type of each key, by count, then severity, then name."""
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("sev"))
    return c.groupBy("user_id").agg(F.max(F.struct("n", "sev", "event_type")).alias("m")).select("user_id", "m.event_type", "m.n")


@query("m_running_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("m_tool_contribution", """
SELECT tool, count(*) AS n, count(*) FILTER (toxic = 1) AS n_toxic FROM (SELECT unnest(string_split(CASE doc_id % 4 WHEN 0 THEN 'a+b' WHEN 1 THEN 'a' WHEN 2 THEN 'b+c+a' ELSE 'c' END, '+')) AS tool, toxic FROM labels) GROUP BY tool""")
def _(spark, d):
    """Joint findings count for each of their tools."""
    key = F.expr("CASE doc_id % 4 WHEN 0 THEN 'a+b' WHEN 1 THEN 'a' WHEN 2 THEN 'b+c+a' ELSE 'c' END")
    x = table(spark, d, "labels").select(F.explode(F.split(key, r"\+")).alias("tool"), "toxic")
    return x.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


@query("m_pair_class", """
SELECT lang, cls, count(*) AS n FROM (SELECT lang, CASE WHEN a = 0 AND b = 0 THEN 'both_zero' WHEN a > b AND b = 0 THEN 'STRONG' WHEN a > b THEN 'WEAK' WHEN a = b THEN 'same' ELSE 'REVERSE' END AS cls FROM (SELECT lang, d.doc_id % 4 AS a, (d.doc_id // 4) % 3 AS b FROM documents d)) GROUP BY lang, cls""")
def _(spark, d):
    """Findings before and after a change, classed."""
    x = table(spark, d, "documents").select("lang", F.expr("doc_id % 4").alias("a"), F.expr("(doc_id DIV 4) % 3").alias("b"))
    cls = F.expr("CASE WHEN a = 0 AND b = 0 THEN 'both_zero' WHEN a > b AND b = 0 THEN 'STRONG' WHEN a > b THEN 'WEAK' WHEN a = b THEN 'same' ELSE 'REVERSE' END")
    return x.groupBy("lang", cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("m_form_spectrum", r"""
WITH f AS (SELECT source, doc_id, regexp_replace(left(text, 12), '[a-z]+', 'a', 'g') AS form FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, form ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source, form) AS n FROM f)
SELECT source, form, max(n) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (rn <= 2) AS examples FROM r GROUP BY source, form""")
def _(spark, d):
    """Counts of forms with their two first examples: bounded state, no list of all members."""
    from pyspark.sql import Window

    f = table(spark, d, "documents").select("source", "doc_id", F.regexp_replace(F.left("text", F.lit(12)), "[a-z]+", "a").alias("form"))
    w = Window.partitionBy("source", "form")
    r = f.withColumns({"rn": F.row_number().over(w.orderBy("doc_id")), "n": F.count(F.lit(1)).over(w)}).where("rn <= 2")
    return r.groupBy("source", "form").agg(F.max("n").alias("n"), F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("examples"))


@query("m_shard_drift", """
WITH s AS (SELECT doc_id % 8 AS shard, avg(toxic::DOUBLE) AS rate, avg(n_chars::DOUBLE) AS len FROM documents JOIN labels USING (doc_id) GROUP BY 1), b AS (SELECT avg(toxic::DOUBLE) AS rate FROM labels JOIN documents USING (doc_id))
SELECT shard, round(s.rate, 4) AS rate, round(len, 2) AS len, round(s.rate - b.rate, 4) AS drift FROM s, b""")
def _(spark, d):
    """Label rate and mean length of shards, against the whole: sums roll up from the shards."""
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy((F.col("doc_id") % 8).alias("shard")).agg(F.sum("toxic").alias("y"), F.count(F.lit(1)).alias("n"), F.avg(F.col("n_chars").cast("double")).alias("len"))
    whole = s.agg(F.sum("y"), F.sum("n")).first()  # one row
    rate = F.col("y") / F.col("n")
    return s.select("shard", F.round(rate, 4).alias("rate"), F.round("len", 2).alias("len"), F.round(rate - F.lit(whole[0] / whole[1]), 4).alias("drift"))


_CV = f"WITH {_VOTE}, h AS (SELECT *, CASE WHEN expected THEN coalesce(1 - t::DOUBLE / nullif(t + f, 0), 1.0) ELSE coalesce(t::DOUBLE / nullif(t + f, 0), 1.0) END AS s FROM votes), o AS (SELECT expected, s, row_number() OVER (PARTITION BY expected ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY expected) AS n FROM h), q AS (SELECT expected, max(s) FILTER (i = greatest(0, least(n - 1, floor(0.9::DOUBLE * (n + 1) - 1)))) AS a, max(s) FILTER (i = greatest(0, least(n - 1, ceil(0.9::DOUBLE * (n + 1) - 1)))) AS b, max(CASE WHEN floor(0.9::DOUBLE * (n + 1) - 1) >= n - 1 THEN 0 ELSE 0.9::DOUBLE * (n + 1) - 1 - floor(0.9::DOUBLE * (n + 1) - 1) END) AS fr FROM o GROUP BY expected), th AS (SELECT max(a * (1 - fr) + b * fr) FILTER (expected) AS qv, max(a * (1 - fr) + b * fr) FILTER (NOT expected) AS qs FROM q)"


@query("s_conformal_fit", f"{_CV} SELECT round(qv, 6) AS q_vuln, round(qs, 6) AS q_safe FROM th")
def _(spark, d):
    votes = M.vote(runs(spark, d), "doc_id").withColumn("label", F.col("expected"))
    return M.conformal_fit(votes).select(F.round("q_vuln", 6).alias("q_vuln"), F.round("q_safe", 6).alias("q_safe"))


@query("s_conformal_predict", f"""{_CV} SELECT doc_id, CASE WHEN iv AND NOT ins THEN 'vulnerable' WHEN ins AND NOT iv THEN 'safe' ELSE 'uncertain' END AS decision FROM (SELECT doc_id, coalesce(coalesce(1 - t::DOUBLE / nullif(t + f, 0), 1.0) <= qv + 1e-9, false) AS iv, coalesce(coalesce(t::DOUBLE / nullif(t + f, 0), 1.0) <= qs + 1e-9, false) AS ins FROM votes, th)""")
def _(spark, d):
    votes = M.vote(runs(spark, d), "doc_id").withColumn("label", F.col("expected"))
    return M.conformal_predict(votes, M.conformal_fit(votes)).select("doc_id", "decision")


@query("s_paired_bootstrap")
def _(spark, d):
    """Difference of two systems' hit rates by source blocks, with an interval from resampling."""
    e = records(spark, d).groupBy(F.col("source").alias("block")).agg(F.count_if(F.expr("predicted = expected")).cast("double").alias("a"), F.count_if(F.expr("expected")).cast("double").alias("b"), F.count(F.lit(1)).cast("double").alias("w"))
    return M.paired_bootstrap(e, "a", "b", "w")
