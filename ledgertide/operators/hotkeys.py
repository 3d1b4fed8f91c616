"""Totals per key where a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals_per_key(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """``(field, key_value, <measures>)``: the measures of each value of each column in ``keys``.

    The measures must be algebraic aggregates (sum, count, min, max, avg): each task folds its rows
    into a hash table that holds one state per key and spills when full, and only those states are
    shuffled. A key with a third of all rows so arrives as one row per task, not as a third of the
    rows; the reduce side has as much work for it as for any other key.

    All keys are served by one pass (an Expand that writes each row once per key column). A null key
    is a group of its own with ``key_value`` null; an empty table gives no rows. Only the columns
    named in ``keys`` and ``measures`` are read.
    """
    pairs = [F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("key_value")) for k in keys]
    return (
        df.withColumn("__key_pair", F.explode(F.array(*pairs)))
        .groupBy(F.col("__key_pair.field").alias("field"), F.col("__key_pair.key_value").alias("key_value"))
        .agg(*[m.alias(name) for name, m in measures.items()])
    )


def keys_above_share(df: DataFrame, keys: list[str], one_in: int) -> DataFrame:
    """``(field, key_value)``: the values that hold more than one row in ``one_in`` of ``df``.

    Counts come from :func:`totals_per_key`; the number of all rows is a one-row subquery that needs no
    column. A null key counts towards all rows but is no value.
    """
    counts = totals_per_key(df, keys, {"rows": F.count(F.lit(1))})
    rows = df.agg(F.count(F.lit(1))).scalar()
    return counts.where(F.col("key_value").isNotNull() & (F.col("rows") * F.lit(one_in) > rows)).select("field", "key_value")
