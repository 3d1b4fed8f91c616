"""Equity of a wallet at a time: the last snapshot, or deposits and profits up to then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.functions.keys import place
from ledgertide.operators.sliced import carried, upto_here, with_slice
from ledgertide.schema import TOTAL


def derived(deposits: DataFrame, effects: DataFrame, at_ms: int) -> DataFrame:
    """``(user, equity)``: deposits up to and at ``at_ms`` plus closed_pnl before it, of users with any."""
    paid = deposits.where(F.col("time_ms") <= at_ms).select("user", "amount")
    made = effects.where(F.col("time_ms") < at_ms).select("user", F.col("closed_pnl").alias("amount"))
    return paid.unionByName(made).groupBy("user").agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL).alias("equity"))


def latest_snapshot(snapshots: DataFrame, at_ms: int) -> DataFrame:
    """``(user, equity)`` of the latest snapshot at or before ``at_ms``; of equal times the highest id."""
    rows = snapshots.where(F.col("time_ms") <= at_ms)
    return rows.groupBy("user").agg(F.max_by("equity", place(F.col("time_ms"), F.col("id"))).cast(TOTAL).alias("equity"))


def at_opening(deposits: DataFrame, at_ms: int | None) -> DataFrame:
    """``(user, opening, paid)``: what each wallet had paid in up to and at ``at_ms``, or without one at its first deposit."""
    if at_ms is not None:
        paid = F.sum(F.when(F.col("time_ms") <= at_ms, F.col("amount")))
        return deposits.groupBy("user").agg(F.lit(at_ms).cast("long").alias("opening"), F.coalesce(paid, F.lit(0)).cast(TOTAL).alias("paid"))
    by_time = deposits.groupBy("user", "time_ms").agg(F.sum("amount").cast(TOTAL).alias("paid"))
    return by_time.groupBy("user").agg(F.min("time_ms").alias("opening"), F.min_by("paid", "time_ms").alias("paid"))


def snapshot_of_each(asked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``(user, equity)`` of the latest snapshot at or before each wallet's ``at_ms``; a wallet is asked for once."""
    at = asked.select(F.col("user").alias("of_user"), "at_ms")
    rows = snapshots.join(at, (F.col("user") == F.col("of_user")) & (F.col("time_ms") <= F.col("at_ms")))
    return rows.groupBy("user").agg(F.max_by("equity", place(F.col("time_ms"), F.col("id"))).cast(TOTAL).alias("equity"))


def at_time(snapshots: DataFrame | None, deposits: DataFrame, effects: DataFrame, at_ms: int) -> DataFrame:
    """The latest snapshot where a user has one, else the derived equity."""
    otherwise = derived(deposits, effects, at_ms)
    if snapshots is None:
        return otherwise
    found = latest_snapshot(snapshots, at_ms)
    return found.unionByName(otherwise.join(found.select("user"), "user", "left_anti"))


def as_of(questions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``questions`` (``user``, ``time_ms``, …) with ``equity`` of the latest snapshot at or before each.

    Both sides are put into one order per user and slice of time, and the last snapshot of earlier slices
    is carried in: no range join, no sort of a whole user. Null where there is no snapshot.
    """
    asked = questions.select("user", "time_ms", F.lit(1).alias("asks"), F.lit(None).cast("long").alias("sid"), F.struct(*questions.columns).alias("q"), F.lit(None).cast(TOTAL).alias("e"))
    known = snapshots.select("user", "time_ms", F.lit(0).alias("asks"), F.col("id").alias("sid"), F.lit(None).cast(asked.schema["q"].dataType).alias("q"), F.col("equity").cast(TOTAL).alias("e"))
    rows = with_slice(asked.unionByName(known), ["user"], "time_ms")
    known_at = F.when(F.col("e").isNotNull(), place(F.col("time_ms"), F.col("sid")))
    rows = carried(rows, {"last_e": F.max_by("e", known_at)}, {"earlier": F.last("last_e", ignorenulls=True)})
    here = F.last("e", ignorenulls=True).over(upto_here("time_ms", "asks", "sid"))
    rows = rows.withColumn("equity", F.coalesce(here, "earlier")).where(F.col("asks") == 1)
    return rows.select("q.*", "equity")
