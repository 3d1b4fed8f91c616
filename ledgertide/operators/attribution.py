"""Whether a fill came through the builder: by its fee, or by the builder's own logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.functions.keys import utc_day

TOLERANCE_MS = 1000
TOLERANCE = "0.000001"


def one_per_fill(attributions: DataFrame) -> DataFrame:
    """One attribution per fill: logs before heuristic, attributed before not, a named builder before none."""
    best = F.max(F.struct((F.col("mode") == "logs").alias("by_logs"), "attributed", "builder", "mode", "confidence"))
    rows = attributions.groupBy("fill_key").agg(best.alias("b"))
    return rows.select("fill_key", "b.attributed", "b.mode", "b.confidence", "b.builder")


def heuristic(fills: DataFrame) -> DataFrame:
    """Attributed if the builder fee is above zero; a missing fee is none."""
    paid = F.coalesce(F.col("builder_fee") > 0, F.lit(False))
    none = F.lit(None).cast("string")
    return fills.select("fill_key", paid.alias("attributed"), F.lit("heuristic").alias("mode"), F.lit("low").alias("confidence"), none.alias("builder"))


def exact_matches(fills: DataFrame, logs: DataFrame) -> DataFrame:
    """Keys of the fills whose ``tid`` stands in the log of their UTC day, whatever the rest says."""
    named = logs.where(F.col("tid").isNotNull()).select("day", "tid")
    return fills.select("fill_key", utc_day(F.col("time_ms")).alias("day"), "tid").join(named, ["day", "tid"], "left_semi").select("fill_key")


def fuzzy_matches(fills: DataFrame, logs: DataFrame, tolerance_ms: int = TOLERANCE_MS, tolerance: str = TOLERANCE) -> DataFrame:
    """Keys of the fills for which the log of their UTC day has a record within the tolerances.

    Wallet and coin are compared without regard to letter case. The band in time becomes an equality:
    records are put into the slices of ``tolerance_ms`` they can match in, so that both sides are hashed
    by wallet, coin, side, day and slice, and no wallet is a hot key.
    """
    key = lambda df: [F.lower("user").alias("u"), F.upper("coin").alias("c"), F.col("side").alias("s")]
    slice_of = F.floor(F.col("time_ms") / tolerance_ms)
    left = fills.select("fill_key", *key(fills), utc_day(F.col("time_ms")).alias("d"), slice_of.alias("b"), "time_ms", "px", "sz")
    right = logs.select(
        *[k.alias(f"{n}2") for k, n in zip(key(logs), "ucs")],
        F.col("day").alias("d2"),
        F.explode(F.sequence(slice_of - 1, slice_of + 1)).alias("b2"),
        F.col("time_ms").alias("t2"),
        F.col("px").alias("px2"),
        F.col("sz").alias("sz2"),
    )
    same = [F.col(n) == F.col(f"{n}2") for n in "ucsdb"]
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(tolerance).cast("decimal(18,8)")
    return left.join(right, [*same, F.abs(F.col("time_ms") - F.col("t2")) <= tolerance_ms, near("px", "px2"), near("sz", "sz2")], "left_semi").select("fill_key")


def attributed(fills: DataFrame, logs: DataFrame | None, mode: str, builder: str | None = None) -> DataFrame:
    """``(fill_key, attributed, mode, confidence, builder)`` of each fill.

    ``heuristic`` goes by the fee. ``logs`` goes by the logs: an exact match, else a fuzzy one, else not
    attributed (with confidence ``exact``). ``auto`` is ``logs`` where that matches, else ``heuristic``;
    without logs (None) it is ``heuristic`` throughout, where ``logs`` is an error.
    """
    if mode not in ("heuristic", "logs", "auto"):
        raise ValueError(f"unknown attribution mode {mode!r}")
    if mode == "heuristic" or (mode == "auto" and logs is None):
        return heuristic(fills)
    if logs is None:
        raise ValueError("mode logs needs builder logs")
    exact = exact_matches(fills, logs).distinct().withColumn("is_exact", F.lit(True))
    fuzzy = fuzzy_matches(fills, logs).distinct().withColumn("is_fuzzy", F.lit(True))
    rows = fills.select("fill_key", "builder_fee").join(exact, "fill_key", "left").join(fuzzy, "fill_key", "left")
    hit = F.col("is_exact").isNotNull() | F.col("is_fuzzy").isNotNull()
    by_fee = F.coalesce(F.col("builder_fee") > 0, F.lit(False))
    confidence = F.when(F.col("is_exact").isNotNull(), "exact").when(F.col("is_fuzzy").isNotNull(), "fuzzy")
    return rows.select(
        "fill_key",
        (hit | by_fee if mode == "auto" else hit).alias("attributed"),
        (F.when(hit, "logs").otherwise("heuristic") if mode == "auto" else F.lit("logs")).alias("mode"),
        F.coalesce(confidence, F.lit("low" if mode == "auto" else "exact")).alias("confidence"),
        F.when(hit, F.lit(builder)).alias("builder"),
    )


def attach(fills: DataFrame, stored: DataFrame | None) -> DataFrame:
    """``fills`` with ``attributed``, ``mode``, ``confidence`` and ``builder``: as stored, else by the fee.

    The stored attributions are the only other table; no fill is looked up among fills.
    """
    paid = F.coalesce(F.col("builder_fee") > 0, F.lit(False))
    if stored is None:
        return fills.withColumns({"attributed": paid, "mode": F.lit("heuristic"), "confidence": F.lit("low"), "builder": F.lit(None).cast("string")})
    have = one_per_fill(stored).withColumnRenamed("fill_key", "__of").withColumn("__is", F.lit(True))
    rows = fills.join(have, F.col("fill_key") == F.col("__of"), "left")
    by_fee = {"attributed": paid, "mode": F.lit("heuristic"), "confidence": F.lit("low"), "builder": F.col("builder")}
    return rows.withColumns({c: F.when(F.col("__is"), F.col(c)).otherwise(v) for c, v in by_fee.items()}).drop("__of", "__is")


def completed(fills: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The stored attribution of each fill, or the heuristic one where none is stored."""
    return attach(fills, stored).select("fill_key", "attributed", "mode", "confidence", "builder")
