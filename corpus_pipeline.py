"""A corpus pipeline over documents: language ID, exact dedup, near dedup, mixing, subword encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared
folder and hands the written rows to the next stage, so a lost executor costs no earlier stage. All
stages but the last return the columns of documents. Empty and null texts have no letter and go in the
first stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import exact_dedup, language_id, mixing, ngram_join, piece_sampling
from quillmill.llm.common import new_path


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language of the corpus fits."""
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one of each group of equal texts, that of the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document, that of the smallest doc_id, of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    return ngram_join.near_dedup(docs, k=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that every source is expected to give as many rows."""
    return _columns(mixing.mix(docs), docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece_ids (a sampled segmentation) and n_pieces."""
    out = piece_sampling.encode(docs)
    return out.select("doc_id", "lang", "source", "piece_ids").withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("source_mixing", mix), ("sentencepiece", pieces)]

#: A trained network and sampled segmentations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
