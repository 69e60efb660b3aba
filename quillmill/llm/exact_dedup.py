"""Exact dedup by deterministic block naming.

Every text is cut into fixed-size blocks. The blocks are sorted and get integer names, equal names
for equal blocks and for those only. Then adjacent names are paired and the pairs named in the same
way, level by level, until each document is left with one integer. Two texts of as many blocks carry
the same integer if and only if they are identical: no name rests on a hash.

Names are made bucket by bucket: a name is the bucket (from a hash of the named thing, so that equal
things meet) and the rank inside it, by sort order. Hence no stage sorts everything in one task. Equal
blocks of one Arrow batch are folded into one row before the shuffle, so a text that fills a third of
the table costs the shuffle one row a batch. The block texts are shuffled once; all later levels move
rows of a few integers.

Defined results: a null text counts as the empty text, which is one empty block; rows with the same
doc_id are kept apart; among equal texts the row with the largest doc_id stays (null lowest), of rows
tied in that one stays; an empty table gives an empty result; other columns are ignored. The input
must be repeatable (a table, or a written intermediate), as rows are numbered by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, join_hot, saved

BLOCK_CHARS = 4096
BUCKETS = 1 << 16
#: A name is bucket * NAME_SPAN + rank.
NAME_SPAN = 1 << 40

_BLOCKS = "block string, members array<struct<rid: bigint, doc_id: bigint, sha: binary, idx: int, n: int>>"


def _cut(block_chars: int):
    kind = pa.struct([("rid", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("idx", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, doc, sha, text = (batch.column(i).to_pylist() for i in range(4))
            at: dict[str, list] = {}
            for r, d, s, t in zip(rid, doc, sha, text, strict=True):
                n = max(1, -(-len(t) // block_chars))
                for i in range(n):
                    at.setdefault(t[i * block_chars : (i + 1) * block_chars] if n > 1 else t, []).append({"rid": r, "doc_id": d, "sha": s, "idx": i, "n": n})
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.string()), pa.array(list(at.values()), pa.list_(kind))], names=["block", "members"])

    return run


def _name(bucket, order: list):
    """Integer name: equal for rows that are equal in `order` columns, and for those only."""
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*order))
    return bucket.cast("long") * F.lit(NAME_SPAN) + rank.cast("long")


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: rid, doc_id, sha (of the text in UTF-8), n (blocks), name."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    cut = rows.mapInArrow(_cut(block_chars), _BLOCKS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int"))
    named = cut.select("members", _name(F.col("bucket"), ["block"]).alias("name"))
    level = saved(named.select(F.explode("members").alias("m"), "name").select("m.*", "name"), "names")
    most = level.agg(F.max("n")).first()[0] or 1
    width = most
    done = level.where("n = 1").select("rid", "doc_id", "sha", "n", "name")
    cur = level.where("n > 1").select("rid", "idx", "name")
    heads = level.where("n > 1 and idx = 0").select("rid", "doc_id", "sha", "n")
    if most == 1:
        return done
    while width > 1:
        half = F.shiftright("idx", 1)
        pairs = cur.groupBy("rid", half.alias("idx")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
        )
        distinct = pairs.select("l", "r").distinct().withColumn("bucket", F.pmod(F.xxhash64("l", "r"), F.lit(buckets)).cast("int"))
        names = distinct.select("l", "r", _name(F.col("bucket"), ["l", "r"]).alias("name"))
        cur = saved(pairs.join(names, ["l", "r"]).select("rid", "idx", "name"), "names")
        width = -(-width // 2)
    return done.union(heads.join(cur.select("rid", "name"), "rid").select("rid", "doc_id", "sha", "n", "name"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: rid, doc_id, keep_id, group_size, kept, text_sha256."""
    named = saved(name_documents(docs, id_col, text_col, block_chars), "named")
    groups = named.groupBy("n", "name").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    return join_hot(named, groups, ["n", "name"]).select(
        "rid", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all their columns untouched.

    docs must be a table or a written intermediate: its rows are numbered by position twice, once to
    name them and once to pick the rows that stay.
    """
    tag = free(docs, "__quillmill_rid")
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("rid").alias(tag))
    return docs.withColumn(tag, F.monotonically_increasing_id()).join(kept, tag, "left_semi").drop(tag)
