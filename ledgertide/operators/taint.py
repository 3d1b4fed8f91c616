"""Lifecycles with a fill that isn't the builder's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.functions.keys import lifecycle_id


def lifecycle_taint(effects: DataFrame, attributions: DataFrame) -> DataFrame:
    """``(lifecycle_id, user, coin, is_tainted, taint_reason)``: tainted by any fill not attributed.

    The reason is that of the bad fill with the smallest key; a fill without attribution is bad too.
    """
    known = attributions.select("fill_key", "attributed", "mode")
    rows = effects.select("lifecycle_id", "user", "coin", "fill_key").join(known, "fill_key", "left")
    return _judged(rows, ["lifecycle_id", "user", "coin"]).select("lifecycle_id", "user", "coin", "is_tainted", "taint_reason")


def moves_taint(moves: DataFrame) -> DataFrame:
    """The same, with ``opener``, from the moves of :func:`~ledgertide.operators.positions.transitions` with ``attributed`` and ``mode``.

    A flip belongs to the lifecycle it closes and to the one it opens. Where the reason isn't asked for
    this is a hash aggregation.
    """
    of = F.explode(F.array_compact(F.array("opener", "closer"))).alias("opener")
    rows = moves.where(F.col("kind") != "none").select("user", "coin", "fill_key", "attributed", "mode", of)
    judged = _judged(rows, ["opener", "user", "coin"])
    return judged.select(lifecycle_id(F.col("opener")).alias("lifecycle_id"), "user", "coin", "is_tainted", "taint_reason", "opener")


def _judged(rows: DataFrame, lifecycle: list[str]) -> DataFrame:
    bad = ~F.coalesce("attributed", F.lit(False))
    unattributed = F.format_string("Fill %s not attributed to builder (mode=%s)", "fill_key", F.initcap("mode"))
    reason = F.when(F.col("attributed").isNull(), F.format_string("Fill %s has no attribution data", "fill_key")).otherwise(unattributed)
    first = F.min(F.when(bad, F.struct("fill_key", reason.alias("reason"))))
    out = rows.groupBy(*lifecycle).agg(F.bool_or(bad).alias("is_tainted"), first.alias("first"))
    return out.select(*lifecycle, "is_tainted", F.col("first.reason").alias("taint_reason"))


def clean_effects(effects: DataFrame, taints: DataFrame) -> DataFrame:
    """The effects of lifecycles known to be clean; a lifecycle without taint information is left out."""
    clean = taints.where(~F.col("is_tainted")).select("lifecycle_id", "user", "coin")
    return effects.join(clean, ["lifecycle_id", "user", "coin"], "left_semi")
