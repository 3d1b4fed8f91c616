"""Scans of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.schema import MONEY, PRICE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder. Filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _decimal(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name).try_cast(kind), F.lit(0).cast(kind)).alias(name)


def text_fills(rows: DataFrame) -> DataFrame:
    """Fills stored with their decimals as texts: a text that isn't a number is 0, a builder fee that isn't one is none; a side that isn't known is a buy."""
    kinds = {"px": PRICE, "sz": PRICE, "fee": MONEY, "closed_pnl": MONEY}
    typed = {c: _decimal(c, k) for c, k in kinds.items()} | {"builder_fee": F.col("builder_fee").try_cast(MONEY), "side": F.when(F.col("side") == "sell", "sell").otherwise("buy")}
    return rows.withColumns(typed)


def text_deposits(rows: DataFrame) -> DataFrame:
    return rows.withColumn("amount", _decimal("amount", MONEY))


def text_attributions(rows: DataFrame) -> DataFrame:
    """Stored attributions: flags may be 0 and 1; an unknown mode is ``heuristic``, an unknown confidence ``low``."""
    known = lambda c, words, otherwise: F.when(F.col(c).isin(words), F.col(c)).otherwise(otherwise)
    return rows.withColumns(
        {
            "attributed": F.coalesce(F.col("attributed").cast("boolean"), F.lit(False)),
            "mode": known("mode", ["heuristic", "logs"], "heuristic"),
            "confidence": known("confidence", ["exact", "fuzzy", "low"], "low"),
        }
    )
