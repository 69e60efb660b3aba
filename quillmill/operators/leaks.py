"""Leaks of evaluation texts, found by both ends of a fragment or by windows of the texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows that one scan of the texts looks for; more are looked for in as many scans as they need.
WINDOW_BLOCK = 100_000


def window_leaks(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, width: int = 60) -> DataFrame:
    """(doc_id, item_id): documents that hold a window of an item: `width` characters from every half width on, or an item of up to that length as a whole.

    The windows of a block stand in one automaton, which reads each whole text once; no text is shuffled. Items are an evaluation set: small beside the
    documents. Ids are long integers. Null and empty texts hold nothing and are held by nothing; equal rows meet once.
    """
    whole = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("t")).where(F.col("t") != "")
    starts = F.sequence(F.lit(1), F.greatest(F.length("t") - width + 1, F.lit(1)), F.lit(max(1, width // 2)))
    windows = whole.select("item", F.explode(F.transform(starts, lambda i: F.substring("t", i, F.lit(width)))).alias("w")).distinct()
    blocks = max(1, -(-windows.count() // WINDOW_BLOCK))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("t"))

    def one(b: int) -> DataFrame:
        by_text: dict[str, list[int]] = {}
        for r in windows.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == b).collect():  # about WINDOW_BLOCK rows
            by_text.setdefault(r["w"], []).append(r["item"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = ahocorasick.Automaton()
            for w, of in by_text.items():
                words.add_word(w, of)
            if by_text:
                words.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, t in enumerate(batch.column(1) if by_text else ()):
                    held = {x for _, of in words.iter(t.as_py()) for x in of} if t.is_valid else ()
                    at += [i] * len(held)
                    found += held
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], names=["doc", "item"])

        return texts.mapInArrow(run, "doc bigint, item bigint")

    found = reduce(DataFrame.union, [one(b) for b in range(blocks)])
    return found.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def both_ends(fragments: DataFrame, items: DataFrame, fragment: str, text: str, item_id: str, width: int = 200) -> DataFrame:
    """fragments joined with the items whose text holds both their first and their last `width` characters.

    Fragments shorter than that meet nothing. The items are cut at every character, so that equal hashes find the front; the
    strings themselves decide. Items should be the smaller side: they give a row a character.
    """
    own = items.select(F.col(item_id), F.col(text).alias("__item")).where(F.length("__item") >= width)
    at = F.explode(F.sequence(F.lit(1), F.length("__item") - width + 1))
    windows = own.select(item_id, "__item", at.alias("__at")).select(item_id, F.xxhash64(F.substring("__item", F.col("__at"), F.lit(width))).alias("__w")).distinct()
    long_ = fragments.where(F.length(fragment) >= width).withColumns({"__front": F.substring(fragment, 1, width), "__back": F.right(F.col(fragment), F.lit(width))})
    front = long_.join(windows.withColumnRenamed("__w", "__f"), F.xxhash64("__front") == F.col("__f"))
    met = front.join(own, item_id).where(F.contains("__item", F.col("__front")) & F.contains("__item", F.col("__back")))
    return met.drop("__front", "__back", "__f", "__item")
