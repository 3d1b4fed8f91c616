"""Ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.operators.storage import written


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 1, in a total order, without gathering it in one task.

    The table is range-sorted and written with each row's place in its partition; the partitions' sizes,
    added up in order, are the offsets.
    """
    placed = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    rows = placed.withColumn("__of", part).join(F.broadcast(sizes), F.col("__of") == F.col("__part"))
    within = F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    return rows.select((F.col("__offset") + within + 1).cast("long").alias(name), *df.columns)
