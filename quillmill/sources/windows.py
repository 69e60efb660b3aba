"""A table taken over window by window of time, resumable: windows that were finished are skipped, one that broke off is written anew.

The windows of a page are written in one job, each to a folder of its own that a later write replaces as a whole, and only then noted as done. A run that
stops anywhere thus leaves no window half done and none twice. The filter on time reaches the scan.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spans(df: DataFrame, time: str, width: timedelta) -> list[tuple[datetime, datetime]]:
    """Windows of a width from the midnight before the first time up to the last; as many as the span has."""
    first, last = df.agg(F.min(time), F.max(time)).first()
    out, lo = [], first and first.replace(hour=0, minute=0, second=0, microsecond=0)
    while first and lo <= last:
        out.append((lo, lo + width))
        lo += width
    return out


def done(df: DataFrame, path: str) -> set[str]:
    """Names of the windows that were finished."""
    try:
        log = df.sparkSession.read.schema("name string").json(f"{path}/done")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    return {r["name"] for r in log.distinct().collect()}


def take_over(df: DataFrame, time: str, width: timedelta, path: str, page: int = 16, most: int | None = None) -> int:
    """Writes the windows of df that aren't done yet to path/data, `page` of them a job and `most` in all; returns how many are left.

    Rows without a time belong to no window and are left out; an empty table has no window. The width must stay the same for a path.
    """
    spark = df.sparkSession
    name = lambda lo: lo.strftime("%Y%m%dT%H%M%S")
    known = done(df, path)
    open_ = [(lo, hi) for lo, hi in spans(df, time, width) if name(lo) not in known]
    now = open_ if most is None else open_[:most]
    kind = df.schema[time].dataType
    for i in range(0, len(now), page):
        some = now[i : i + page]
        at = lambda t: F.lit(t.isoformat(sep=" ")).cast(kind)
        inside = df.where((F.col(time) >= at(some[0][0])) & (F.col(time) < at(some[-1][1])))
        label = F.lit(None).cast("string")
        for lo, hi in some:
            label = F.when((F.col(time) >= at(lo)) & (F.col(time) < at(hi)), name(lo)).otherwise(label)
        rows = inside.withColumn("window", label).where("window IS NOT NULL")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("window").parquet(f"{path}/data")
        spark.createDataFrame([(name(lo),) for lo, _ in some], "name string").coalesce(1).write.mode("append").json(f"{path}/done")
    return len(open_) - len(now)


def taken(df: DataFrame, path: str) -> DataFrame:
    """Rows of the finished windows, with the window's name."""
    names = done(df, path)
    schema = df.schema.add("window", "string")
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    return df.sparkSession.read.schema(schema).parquet(f"{path}/data").where(F.col("window").isin(*names))
