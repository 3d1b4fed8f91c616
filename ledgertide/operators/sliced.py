"""Running values over long histories that are worked on in slices of time.

A window over all rows of a busy entity would sort them in one task. Here the rows of an entity are cut
into slices of time; what a slice hands on is folded into one row, those rows are put in order, and each
slice starts from what reached it.

The entity's columns are held in one struct, as structs with nulls inside compare as equal: windows and
joins by entity and slice then share one hash partitioning, nulls being entities of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICE_MS = 6 * 3_600_000


def with_slice(df: DataFrame, keys: list[str], time: str, width: int = SLICE_MS) -> DataFrame:
    """``df`` with ``__key`` and ``__slice``, by which :func:`carried` and the windows work."""
    return df.withColumn("__key", F.struct(*keys)).withColumn("__slice", F.floor(F.col(time) / width))


def in_slice(*order: str) -> WindowSpec:
    return Window.partitionBy("__key", "__slice").orderBy(*order)


def upto_here(*order: str) -> WindowSpec:
    """Within the slice, the rows up to the current one."""
    return in_slice(*order).rowsBetween(Window.unboundedPreceding, 0)


def before_here(*order: str) -> WindowSpec:
    return in_slice(*order).rowsBetween(Window.unboundedPreceding, -1)


def carried(df: DataFrame, fold: dict[str, Column | str], hand_on: dict[str, Column], of: Column | None = None) -> DataFrame:
    """``df`` with what reaches its slice from the entity's earlier slices.

    ``fold`` aggregates a slice into columns; ``hand_on`` are aggregates over those columns that, taken
    over all earlier slices, become columns of ``df`` (null in an entity's first slice). With ``of``, one
    row per slice, the rows it is true of, stand for their slices, and nothing has to be aggregated.

    The slices' side has a row per slice, never more than ``df``; its parts are hashed for the join, so
    the rows of ``df`` are neither sorted for it nor, where they are partitioned by entity and slice, moved.
    """
    earlier = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    if of is None:
        slices = df.groupBy("__key", "__slice").agg(*[c.alias(n) for n, c in fold.items()])
    else:
        slices = df.where(of).select("__key", "__slice", *[F.col(c).alias(n) for n, c in fold.items()])
    slices = slices.select(F.col("__key").alias("__key2"), F.col("__slice").alias("__slice2"), *[c.over(earlier).alias(n) for n, c in hand_on.items()])
    same = (df["__key"] == slices["__key2"]) & (df["__slice"] == slices["__slice2"])
    return df.join(slices.hint("shuffle_hash"), same).drop("__key2", "__slice2")
