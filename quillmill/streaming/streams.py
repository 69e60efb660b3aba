"""Streaming forms of the keyed states: totals, windows, dedup and evidence that resets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVIDENCE = "rule string, confirmed int, rejected int, files int, ready boolean"
_STATE = "confirmed int, rejected int, files array<string>"


def running_totals(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts and sums per key, in update or complete mode."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))


def tumbling(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts per window of event time and key; events later than `late` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Counts per session: events of a key no further apart than the gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), *by, "n")


def fresh(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first event of each key within the watermark; the state of older keys goes."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def fold_evidence(state: tuple[int, int, list[str]], rows: pd.DataFrame, most_files: int = 1000) -> tuple[int, int, list[str]]:
    """A confirmation counts once per file; a rejection clears the confirmations."""
    confirmed, rejected, files = state
    for ok, file in zip(rows["ok"].tolist(), rows["file"].tolist(), strict=True):
        if ok:
            if file not in files and len(files) < most_files:
                files = [*files, file]
                confirmed += 1
        else:
            confirmed, files, rejected = 0, [], rejected + 1
    return confirmed, rejected, files


def evidence(events: DataFrame, least_files: int = 2) -> DataFrame:
    """Keyed evidence of a stream (rule, file, ok, seq): confirmations from distinct files since the last rejection."""

    def update(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, [])
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        c, r, files = fold_evidence((now[0], now[1], list(now[2])), rows)
        state.update((c, r, files))
        yield pd.DataFrame([(key[0], c, r, len(files), len(files) >= least_files)], columns=["rule", "confirmed", "rejected", "files", "ready"])

    return events.groupBy("rule").applyInPandasWithState(update, EVIDENCE, _STATE, "update", "NoTimeout")


def evidence_batch(events: DataFrame, least_files: int = 2) -> DataFrame:
    """The same over a whole table, without a fold: what stands behind a rule's last rejection."""
    last = events.groupBy("rule").agg(F.max(F.when(~F.col("ok"), F.col("seq"))).alias("last"), F.count_if(~F.col("ok")).cast("int").alias("rejected"))
    after = events.join(last, "rule").where(F.col("ok") & (F.col("last").isNull() | (F.col("seq") > F.col("last"))))
    n = after.select("rule", "file").distinct().groupBy("rule").agg(F.count(F.lit(1)).cast("int").alias("files"))
    return last.join(n, "rule", "left").select("rule", F.coalesce("files", F.lit(0)).alias("confirmed"), "rejected", F.coalesce("files", F.lit(0)).alias("files"), (F.coalesce("files", F.lit(0)) >= least_files).alias("ready"))


def run_to_table(stream: DataFrame, path: str, mode: str = "append"):
    """Runs a stream over what is there now into Parquet files, with its checkpoint beside them."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
