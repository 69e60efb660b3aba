"""Ranks, quotas, samples, splits and budgets: windows over bounded keys, hashes for order, folds where order decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: weights of a file's risk score
ABS_CAP, DENSITY_CAP, REPEAT_CAP = 15.0, 15.0, 5
TINY, HUGE, HAS_ENTRY, HAS_SOURCE, HAS_SINK, SECRET, SECRET_CAP = -12.0, -6.0, 4.0, 3.0, 3.0, 4.0, 2
TINY_LINES, HUGE_LINES = 5, 3000


def risk_score(text: Column, sink: str, source: str, entry: str, secret: str) -> Column:
    """Score of a text by counts of patterns, each counted up to REPEAT_CAP, in amount and per 100 lines, and by its size."""
    t = F.coalesce(text, F.lit(""))
    lines = F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)
    n = {k: F.least(F.regexp_count(t, F.lit(p)), F.lit(REPEAT_CAP)) for k, p in (("sink", sink), ("source", source), ("entry", entry))}
    amount = (n["sink"] * 3 + n["source"] * 2 + n["entry"]).cast("double")
    out = F.least(amount, F.lit(ABS_CAP)) + F.least(amount * 100.0 / F.greatest(lines, F.lit(1)), F.lit(DENSITY_CAP))
    for k, w in (("entry", HAS_ENTRY), ("source", HAS_SOURCE), ("sink", HAS_SINK)):
        out = out + F.when(n[k] > 0, w).otherwise(0.0)
    out = out + F.least(F.regexp_count(t, F.lit(secret)), F.lit(SECRET_CAP)) * SECRET
    return F.round(out + F.when(lines < TINY_LINES, TINY).when(lines > HUGE_LINES, HUGE).otherwise(0.0), 3)


def hash_order(key: Column, seed: str) -> Column:
    """A repeatable random order: the MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary"))


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stratified_sample(df: DataFrame, strata: list[str], key: str, least: int, share: int, seed: str) -> DataFrame:
    """Of each stratum of n rows min(n, max(least, n div share)), in hash order; with rank."""
    w = Window.partitionBy(*strata)
    ranked = df.withColumns({"rank": F.row_number().over(w.orderBy(hash_order(F.col(key), seed), key)), "__n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("__n") / share))).drop("__n")


def balanced_phases(df: DataFrame, order: list, cuts: list[float]) -> DataFrame:
    """df with its phase: rows in order, cut after floor(n * share) rows each, the last takes the rest.

    The order of all rows is made by ranges: rows are sorted across partitions, the partitions' sizes
    (one number each) give the offsets, and positions follow inside each.
    """
    from .checkpoints import cut

    placed = cut(df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    sizes = {r["__p"]: r["count"] for r in placed.groupBy("__p").count().collect()}
    total, before, at = sum(sizes.values()), {}, 0
    for p in sorted(sizes):
        before[p], at = at, at + sizes[p]
    offset = F.coalesce(F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv])[F.col("__p")], F.lit(0))
    # the low 33 bits of the id are the row's place in its partition
    position = offset + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    ends, upto = [], 0
    for share in cuts[:-1]:
        upto += int(total * share)
        ends.append(upto)
    phase = F.lit(len(cuts))
    for i in range(len(ends) - 1, -1, -1):
        phase = F.when(position < ends[i], F.lit(i + 1)).otherwise(phase)
    return placed.withColumn("phase", phase).drop("__p", "__i")


def fold_structures(df: DataFrame, fingerprint: str, score: str, path: str, below: float = 0.0) -> DataFrame:
    """df with folded: rows that score under `below` and aren't the first of their fingerprint by score and path."""
    w = Window.partitionBy(fingerprint).orderBy(F.desc(score), path)
    low = F.col(score) < below
    return df.withColumn("folded", low & (F.row_number().over(Window.partitionBy(fingerprint, low).orderBy(F.desc(score), path)) > 1)) if below is not None else df.withColumn("folded", F.row_number().over(w) > 1)


def category_cap(df: DataFrame, item: str, category: str, order: list, per_category: int, total: int, line: str) -> DataFrame:
    """Up to per_category rows of a category and `total` of an item, the category's first row with the lines of what was cut."""
    w = Window.partitionBy(item, category).orderBy(*order)
    ranked = df.withColumn("__rn", F.row_number().over(w))
    kept = ranked.withColumn("__k", F.col("__rn") <= per_category)
    extra = F.array_sort(F.collect_list(F.when(~F.col("__k"), F.col(line))).over(Window.partitionBy(item, category)))
    out = kept.withColumn("extra_lines", F.when(F.col("__rn") == 1, F.array_join(extra.cast("array<string>"), ",")).otherwise(F.lit(""))).where("__k")
    return top_k(out, [item], order, total).drop("__rn", "__k")


def cluster_quota(df: DataFrame, cluster: str, key: str, quota: int) -> DataFrame:
    """Rows taken in turns over clusters, larger clusters first, until the quota."""
    w = Window.partitionBy(cluster)
    r = df.withColumns({"__rn": F.row_number().over(w.orderBy(key)), "__size": F.count(F.lit(1)).over(w), "__first": F.min(key).over(w)})
    return r.orderBy("__rn", F.desc("__size"), "__first").limit(quota).drop("__size", "__first").withColumnRenamed("__rn", "turn")
