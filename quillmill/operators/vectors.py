"""Exact nearest neighbours of stated queries among all vectors, and retrieval reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

#: Up to so many query vectors go to every task; more are joined in blocks of that size.
QUERY_BLOCK = 2_000
#: Rows of a batch that are compared at once.
PIECE = 1_000


def knn(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", where: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest by squared distance, ties by id, of each query among base rows that pass `where`.

    Each task scores its vectors against a block of queries and keeps k for each, so only k rows per query and task are shuffled.
    """
    import numpy as np
    import pandas as pd

    rows = base.where(where) if where else base
    q = queries.select(F.col(id_col).cast("long").alias("q"), F.col(vec_col).alias("v"))
    out = None
    n = queries.count()
    spread = max(1, -(-n // QUERY_BLOCK))
    for i in range(spread):
        part = q.where(F.pmod(F.xxhash64("q"), F.lit(spread)) == i) if spread > 1 else q
        got = part.collect()  # about QUERY_BLOCK rows
        ids = np.array([r["q"] for r in got], np.int64)
        vs = np.array([r["v"] for r in got], np.float64)

        def run(parts, ids=ids, vs=vs):
            if not len(ids):
                return
            best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for p in parts:
                # a batch is compared in pieces, so that distances and their orders stay small
                for lo in range(0, len(p), PIECE):
                    some = p.iloc[lo : lo + PIECE]
                    x, own = np.array(some["v"].tolist(), np.float64), some["id"].to_numpy(np.int64)
                    for a in range(0, len(ids), 256):
                        dist = np.stack([((x - v) ** 2).sum(1) for v in vs[a : a + 256]])
                        d = np.concatenate([best_d[a : a + 256], dist], 1)
                        j = np.concatenate([best_i[a : a + 256], np.broadcast_to(own, (len(dist), len(own)))], 1)
                        order = np.lexsort((j, d), axis=1)[:, :k]
                        best_d[a : a + 256], best_i[a : a + 256] = np.take_along_axis(d, order, 1), np.take_along_axis(j, order, 1)
            ok = np.isfinite(best_d)
            yield pd.DataFrame({"query_id": np.repeat(ids, k)[ok.ravel()], "id": best_i[ok], "distance": best_d[ok]})

        found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInPandas(run, "query_id long, id long, distance double")
        out = found if out is None else out.union(found)
    return top_k(out, ["query_id"], ["distance", "id"], k)


def hit_rates(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """For each k the share of queries with a neighbour of their own label among the first k."""
    j = ranked.join(truth.select(F.col("id"), F.col("label").alias("l")), "id").join(truth.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    best = j.groupBy("query_id").agg(F.min(F.when(F.col("l") == F.col("ql"), F.col("rank"))).alias("first"))
    return best.agg(*[F.round(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")), 4).alias(f"hit_{k}") for k in ks])


def contexts(ranked: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(query_id, context): the texts of the ranked neighbours in order, joined, cut at `most` characters."""
    j = ranked.join(texts.select("id", "text"), "id")
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return j.groupBy("query_id").agg(F.left(F.array_join(F.transform(parts, lambda x: x["text"]), "\n---\n"), F.lit(most)).alias("context"))
