"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_written(df: DataFrame, key: str, order: str, same: list[str] | None = None) -> DataFrame:
    """Of the rows of each key the one with the smallest ``order``: the first write wins.

    ``order`` is unique per key or its equals are equal in every column. Copies are folded within each
    task before the shuffle, so a key that is stored again and again costs one row per task. Rows with a
    null key are one key, as in SQL's DISTINCT. All columns are kept, in their order.

    ``same`` names columns in which all rows of a key agree. If the others are of fixed width (numbers,
    flags, dates), nothing is sorted: this runs as a hash aggregation. Without it whole rows are compared,
    which sorts them. Where rows of a key don't agree after all, each of their values has a first write.
    """
    if same is None:
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        return df.groupBy(F.col(key).alias("__key")).agg(F.min_by(whole, F.struct(order)).alias("__row")).select("__row.*")
    others = [c for c in df.columns if c != key and c not in same]
    first = df.groupBy(key, *same).agg(*[F.min(order).alias(c) if c == order else F.min_by(c, order).alias(c) for c in others])
    return first.select(*df.columns)


def last_written(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of each key the one with the largest ``order``: a later write replaces the earlier."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("__key")).agg(F.max_by(whole, F.struct(*order)).alias("__row")).select("__row.*")


def new_rows(incoming: DataFrame, stored: DataFrame, key: str, order: str, same: list[str] | None = None) -> DataFrame:
    """What an idempotent append adds: the first write of each key that isn't stored yet, ``same`` as in :func:`first_written`."""
    return first_written(incoming, key, order, same).join(stored.select(key), key, "left_anti").select(*incoming.columns)


def copies_folded(df: DataFrame, key: str, same: list[str], sums: dict[str, Column], least: list[str]) -> DataFrame:
    """One row per ``key`` and ``same`` with ``sums`` over its copies and the least value of each of ``least``.

    For copies that agree wherever it matters: as no whole row has to be carried, this runs as a hash
    aggregation with map-side combining. Rows with a null key are copies of each other, as in SQL; where each
    is a row of its own, give them an id and name it in ``same``.
    """
    return df.groupBy(key, *same).agg(*[c.alias(n) for n, c in sums.items()], *[F.min(c).alias(c) for c in least])
