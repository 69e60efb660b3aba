"""Helpers that several operators share: shared-folder paths, checkpoints, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir or the session's checkpoint folder.

    Where neither is set, a local session gets a temporary folder, and a cluster an error: its executors would write to disks of their own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.quillmill.shared.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.quillmill.shared.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """The same rows, read from Parquet files in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """name, or with underscores behind it, so that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


HOT = 1000


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """rows joined with side (one row for each key at most), where a few keys may hold a large part of rows.

    Keys of more than 1 / HOT of all rows, of which there are fewer than HOT, have their row of side broadcast; rows of the
    other keys are shuffled. rows and side should be tables or written intermediates, as they are read more than once.
    sizes (keys, size) are the numbers of rows by key, if they are known, at least those of the large ones.
    """
    total = rows.count() if sizes is None else sizes.agg(F.sum("size")).first()[0] or 0
    sizes = sizes if sizes is not None else rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    hot = F.broadcast(sizes.where(F.col("size") > total / HOT).select(*keys))
    beside = F.broadcast(side.join(hot, keys, "left_semi"))
    return rows.join(hot, keys, "left_semi").join(beside, keys, how).unionByName(rows.join(hot, keys, "left_anti").join(side, keys, how))


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b) as (id, component_id), component_id the smallest id reached.

    Each round hooks every node under the smallest label next to it and then jumps to that label's
    own label, so long chains shrink by powers; the labels are saved between rounds. Nodes without a
    link are not returned. Empty links give an empty result.
    """
    edges = saved(links.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y")), "edges")
    both = edges.union(edges.select("y", "x"))
    labels = saved(both.groupBy("x").agg(F.least("x", F.min("y")).alias("l")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("x").alias("y"), F.col("l").alias("ny")), "y").groupBy("x").agg(F.min("ny").alias("ny"))
        # what a node's neighbours say is also news for the node's present label
        hooked = labels.join(near, "x").select("x", "l", F.least("l", "ny").alias("m"))
        told = hooked.groupBy(F.col("l").alias("x")).agg(F.min("m").alias("told"))
        step = hooked.join(told, "x", "left").select("x", "l", F.least("m", F.coalesce("told", "m")).alias("m"))
        up = step.select(F.col("x").alias("m"), F.col("m").alias("mm"))
        fresh = saved(step.join(up, "m", "left").select("x", F.least("m", F.coalesce("mm", "m")).alias("l"), (F.col("l") != F.least("m", F.coalesce("mm", "m"))).alias("moved")), "labels")
        moved = fresh.where("moved").limit(1).count()
        labels = fresh.select("x", "l")
        if not moved:
            return labels.select(F.col("x").alias("id"), F.col("l").alias("component_id"))
    raise RuntimeError("components did not settle; raise max_rounds")
