"""A collection of vectors in files: add, upsert, delete, count, and search through cells.

Cells are the regions of centers that k-means finds on a bounded sample (SAMPLE vectors, those of the smallest hashes of their ids); every vector is put into the
cell of its nearest center. A collection is a folder of Parquet files, a subfolder a cell; nothing is ever rewritten: an upsert appends rows of a
later version, a deletion appends marks, and what counts is the last version of an id. Versions are numbers of the writes, so a repeated
write after a failure gives the same rows again.

A search asks the `probes` nearest cells of each query; with all cells it is exact. Vectors aren't shuffled: each task scores its rows against the
queries that ask their cell and keeps k a query. How many cells a collection needs depends on its vectors:
tune() measures it on a few queries, and recall() holds all queries against the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import top_k

SAMPLE, CELLS, PROBES = 20_000, 32, 18
#: Queries that go to every task at once.
QUERY_BLOCK = 2_000
#: Rows of a batch that are scored at once.
PIECE = 1_000
#: Queries that tune() measures, and the recall it asks for.
TUNED, AIM = 200, 0.96


def fit_centers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: int = CELLS, sample: int = SAMPLE, seed: int = 7) -> list[list[float]]:
    """Centers of a bounded sample; fewer vectors than cells give fewer."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    some = df.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("v"), h.alias("h")).orderBy("h", "v").limit(sample).select(array_to_vector("v").alias("features"))
    n = some.count()
    if n <= 1:
        return [r.features.toArray().tolist() for r in some.collect()] or [[]]
    model = KMeans(k=min(cells, n), seed=seed, maxIter=15).fit(some)
    return [c.tolist() for c in model.clusterCenters()]


def _nearest(x: np.ndarray, centers: np.ndarray, many: int) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None, :]
    return np.argsort(d, axis=1, kind="stable")[:, :many]


class VectorStore:
    """A collection under a path: centers, and rows (id, cell, version, deleted, vector, meta)."""

    ROW = "id long, version int, deleted boolean, vector array<float>, meta map<string, string>, cell int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, centers: list[list[float]]) -> VectorStore:
        store = cls(spark, path)
        spark.createDataFrame([(i, c) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{store.path}/centers")
        spark.createDataFrame([], cls.ROW).write.partitionBy("cell").parquet(f"{store.path}/rows")
        return store

    def centers(self) -> np.ndarray:
        """As many as were fitted, a bounded number."""
        return np.array([r["center"] for r in self.spark.read.parquet(f"{self.path}/centers").orderBy("cell").collect()])

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.ROW).parquet(f"{self.path}/rows")

    def _version(self) -> int:
        return (self.rows().agg(F.max("version")).first()[0] or 0) + 1

    def _append(self, df: DataFrame, version: int) -> None:
        centers = self.centers()

        def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p):
                    p["cell"] = _nearest(np.array(p["vector"].tolist(), np.float64), centers, 1)[:, 0]
                    yield p[["id", "version", "deleted", "vector", "meta", "cell"]]

        placed = df.withColumns({"version": F.lit(version), "deleted": F.lit(False)}).select("id", "version", "deleted", "vector", "meta").mapInPandas(cells, self.ROW)
        # rows of a cell are dealt to several files, so that a large cell isn't one task's
        placed.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def _input(self, df: DataFrame, id_col: str, vec_col: str, meta: list[str]) -> DataFrame:
        pairs = [x for m in meta for x in (F.lit(m), F.col(m).cast("string"))]
        kept = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
        made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        rows = kept.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vector"), made.alias("meta"))
        return rows.groupBy("id").agg(F.max(F.struct("vector", F.map_entries("meta").alias("m"))).alias("x")).select("id", F.col("x.vector").alias("vector"), F.map_from_entries("x.m").alias("meta"))

    def upsert(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", meta: tuple[str, ...] = ()) -> None:
        """Writes vectors over those of equal ids. Rows without id or vector are left out; of rows of one id in df the largest vector is taken."""
        self._append(self._input(df, id_col, vec_col, list(meta)), self._version())

    def add(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", meta: tuple[str, ...] = ()) -> None:
        """As upsert, but ids that are there already are an error, and nothing is written."""
        rows = self._input(df, id_col, vec_col, list(meta))
        if rows.join(self.live().select("id"), "id", "left_semi").limit(1).count():
            raise ValueError("an id is in the collection already")
        self._append(rows, self._version())

    def delete(self, ids: DataFrame, id_col: str = "vec_id") -> None:
        """Marks ids as deleted; unknown ones do nothing."""
        gone = self.live().select("id", "cell").join(ids.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
        marks = gone.withColumns({"version": F.lit(self._version()), "deleted": F.lit(True), "vector": F.lit(None).cast("array<float>"), "meta": F.lit(None).cast("map<string,string>")})
        marks.select("id", "version", "deleted", "vector", "meta", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def live(self) -> DataFrame:
        """The last version of every id that isn't deleted. Only ids and versions are shuffled to find it, then the rows by both."""
        last = self.rows().groupBy("id").agg(F.max(F.struct("version", "deleted")).alias("l")).where("NOT l.deleted").select("id", F.col("l.version").alias("version"))
        return self.rows().where("NOT deleted").join(last, ["id", "version"])

    def count(self) -> int:
        return self.live().count()

    def tune(self, queries: DataFrame, k: int, aim: float = AIM, least: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding") -> int:
        """The fewest cells, `least` or more, that give a recall of `aim` for up to TUNED of the queries, those of the smallest hashes; measured against all cells."""
        centers = self.centers()
        some = queries.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(TUNED).select(id_col, vec_col)
        cells = self.live().select("id", "cell")
        exact = self.search(some, k, len(centers), id_col, vec_col).join(cells, "id").select(F.col("query_id").alias("q"), "cell").collect()  # TUNED * k rows
        if not exact:
            return least
        vs = {r[0]: r[1] for r in some.collect()}
        places = {q: np.argsort(_nearest(np.array([v], np.float64), centers, len(centers))[0]) for q, v in vs.items()}
        asked = np.sort([int(places[r["q"]][r["cell"]]) + 1 for r in exact])
        return max(least, int(asked[min(len(asked), int(np.ceil(aim * len(asked)))) - 1]))

    def search(self, queries: DataFrame, k: int, probes: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding", where: dict[str, str] | None = None) -> DataFrame:
        """(query_id, id, distance, rank): of each query the k nearest rows in the cells asked, by squared distance, then id. where: metadata that rows must have."""
        centers = self.centers()
        base = self.live()
        for name, value in (where or {}).items():
            base = base.where(F.col("meta")[name] == value)
        asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("q"), F.col(vec_col).cast("array<double>").alias("v"))
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        out = None
        for b in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK rows
            ids, vs = np.array([r["q"] for r in part], np.int64), np.array([r["v"] for r in part], np.float64)
            cells = _nearest(vs, centers, probes) if len(ids) else np.zeros((0, 1), np.int64)
            of_cell = {c: np.flatnonzero((cells == c).any(1)) for c in range(len(centers))}

            def run(parts, ids=ids, vs=vs, of_cell=of_cell):
                dist, near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
                for p in (x.iloc[lo : lo + PIECE] for x in parts for lo in range(0, len(x), PIECE)):
                    own, cell = p["id"].to_numpy(np.int64), p["cell"].to_numpy()
                    x = np.array(p["vector"].tolist(), np.float64)
                    for c in np.unique(cell).tolist():
                        at, q = np.flatnonzero(cell == c), of_cell[c]
                        for lo in range(0, len(q) if len(at) else 0, max(1, 500_000 // (len(at) * x.shape[1]))):
                            some = q[lo : lo + max(1, 500_000 // (len(at) * x.shape[1]))]
                            new = ((vs[some][:, None, :] - x[at][None, :, :]) ** 2).sum(2)
                            d = np.concatenate([dist[some], new], 1)
                            j = np.concatenate([near[some], np.broadcast_to(own[at], new.shape)], 1)
                            order = np.lexsort((j, d), axis=1)[:, :k]
                            dist[some], near[some] = np.take_along_axis(d, order, 1), np.take_along_axis(j, order, 1)
                ok = np.isfinite(dist)
                yield pd.DataFrame({"query_id": np.repeat(ids, k)[ok.ravel()], "id": near[ok], "distance": dist[ok]})

            wanted = [c for c, q in of_cell.items() if len(q)]
            found = base.where(F.col("cell").isin(wanted)).select("id", "cell", "vector").mapInPandas(run, "query_id long, id long, distance double")
            out = found if out is None else out.union(found)
        return top_k(out, ["query_id"], ["distance", "id"], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_queries, n_exact, n_found, recall): how many of the exact neighbours (query_id, id) were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_exact"))
