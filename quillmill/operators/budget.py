"""A budget filled in order, one row after the other, over partitions: an ordered fold without a task for a whole group.

The rows of a group are dealt to partitions in their order, so that a large group spans many. In a round the running sums, from sums in partitions and
the sums of the partitions before, tell the longest run of rows that fits what is left of the budget. The row behind it doesn't fit, nor does any
larger one later on, as what is left only shrinks: they go, and the next round begins with the rest. Every round takes or drops a row of
each group; rounds are as many as there are runs, which on mixed sizes are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut


def char_budget(df: DataFrame, group: str, order: list[str], size: str, most: int, ascending: list[bool], most_rows: int | None = None) -> DataFrame:
    """df with selected: rows in order while their sizes fit the group's budget; one that doesn't fit is skipped and the next tried, the first row is always taken.

    most_rows: at most so many of a group. Rows that tie in order are taken in any order; a null size counts as 0, a negative one isn't allowed; null is a group of its own.
    """
    sort = [F.col(f"`{o}`").asc() if up else F.col(f"`{o}`").desc() for o, up in zip(order, ascending, strict=True)]
    key = F.when(F.col(f"`{group}`").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(f"`{group}`").cast("string")))
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__g", key).repartitionByRange(many, F.col("__g"), *sort).withColumn("__part", F.spark_partition_id())
    placed = cut(dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy("__g", *sort))))
    rows = placed.select("__g", "__part", "__i", F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0).cast("long")).alias("n"))

    before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__part", "__g").orderBy("__i")

    def summed(left: DataFrame) -> DataFrame:
        """left with upto: the running sum in its group, and the place of the first row of the group."""
        parts = left.groupBy("__g", "__part").agg(F.sum("n").alias("t"), F.min("__i").alias("i"))
        parts = parts.withColumns({"off": F.coalesce(F.sum("t").over(before), F.lit(0)), "head": F.first("i").over(Window.partitionBy("__g").orderBy("__part")), "head_part": F.first("__part").over(Window.partitionBy("__g").orderBy("__part"))})
        return left.join(parts.select("__g", "__part", "off", "head", "head_part"), ["__g", "__part"]).withColumn("upto", F.col("off") + F.sum("n").over(inside))

    def spread(by_group: DataFrame, left: DataFrame) -> DataFrame:
        """A row a group -> a row for each partition the group has rows in."""
        return left.select("__g", "__part").distinct().join(by_group, "__g")

    first = summed(rows).withColumn("taken", (F.col("__part") == F.col("head_part")) & (F.col("__i") == F.col("head")))
    first = cut(first)
    taken = first.where("taken").select("__part", "__i")
    budget = first.where("taken").select("__g", (F.lit(most) - F.col("n")).alias("room"))
    left = first.where("NOT taken").select("__g", "__part", "__i", "n").join(spread(budget, rows), ["__g", "__part"]).where("n <= room")
    left = cut(left)
    while left.limit(1).count():
        run = cut(summed(left.select("__g", "__part", "__i", "n", "room")))
        fits = F.col("upto") <= F.col("room")
        taken = taken.union(run.where(fits).select("__part", "__i"))
        used = run.groupBy("__g").agg(F.max("room").alias("room"), F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("used"))
        rest = run.where(~fits).select("__g", "__part", "__i", "n")
        now = used.select("__g", (F.col("room") - F.col("used")).alias("room"))
        left = cut(rest.join(spread(now, rest), ["__g", "__part"]).where("n <= room"))
    chosen = taken.withColumn("__t", F.lit(True))
    out = placed.join(chosen, ["__part", "__i"], "left").withColumn("selected", F.coalesce("__t", F.lit(False)))
    if most_rows is not None:
        # how many of the group are chosen before, from counts in partitions and those of the partitions before
        out = cut(out)
        counts = out.groupBy("__g", "__part").agg(F.sum(F.col("selected").cast("int")).alias("t")).withColumn("off", F.coalesce(F.sum("t").over(before), F.lit(0))).select("__g", "__part", "off")
        out = out.join(counts, ["__g", "__part"]).withColumn("selected", F.col("selected") & (F.col("off") + F.sum(F.col("selected").cast("int")).over(inside) <= most_rows))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "selected")
