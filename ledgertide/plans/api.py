"""Report rows as JSON bodies: names in camel case, numbers as texts, absent values left out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions.keys import decimal_text
from ledgertide.plans import reports
from ledgertide.plans.reports import Ledger
from ledgertide.schema import FILL_ORDER
from ledgertide.sources.feeds import SUMMARY

# The names in the bodies.
TRADE = {"time_ms": "timeMs", "coin": "coin", "side": "side", "px": "px", "sz": "sz", "fee": "fee", "closed_pnl": "closedPnl", "builder": "builder"}
POSITION = {"time_ms": "timeMs", "coin": "coin", "net_size": "netSize", "avg_entry_px": "avgEntryPx", "lifecycle_id": "lifecycleId", "tainted": "tainted"}
DEPOSIT = {"time_ms": "timeMs", "amount": "amount", "tx_hash": "txHash"}
PNL = {"realized_pnl": "realizedPnl", "return_pct": "returnPct", "fees_paid": "feesPaid", "trade_count": "tradeCount"}
BOARD = {"rank": "rank", "user": "user", "metric_value": "metricValue", "trade_count": "tradeCount"}
TAINTED = {"tainted": "tainted"}
RISK = {
    "coin": "coin", "size": "size", "entry_px": "entryPx", "position_value": "positionValue", "unrealized_pnl": "unrealizedPnl",
    "liquidation_px": "liquidationPx", "leverage": "leverage", "margin_used": "marginUsed", "max_leverage": "maxLeverage",
}
MARGIN = {column: name for name, column in SUMMARY.items()}


def _shaped(df: DataFrame, names: dict[str, str]) -> Column:
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        if kinds[c].startswith("decimal"):
            return decimal_text(F.col(c))
        return F.col(c).cast("string") if c == "lifecycle_id" else F.col(c)

    return F.struct(*[value(c).alias(n) for c, n in names.items() if c in kinds])


def rows_json(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """One JSON text per row, as column ``body``; nulls are left out."""
    return df.select(F.to_json(_shaped(df, names)).alias("body"))


def _listed(df: DataFrame, names: dict[str, str], order: list[str], by: str) -> DataFrame:
    """``(<by>, listed)``: the rows of one wallet as an array of structs, in order."""
    entry = F.struct(*order, _shaped(df, names).alias("__body"))
    return df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["__body"]).alias("listed"))


def list_json(df: DataFrame, names: dict[str, str], order: list[str], field: str, by: str = "user") -> DataFrame:
    """``(<by>, body)``: the rows of one wallet as an array under ``field``, in order.

    For answers to one wallet's request; it gathers that wallet's rows.
    """
    return _listed(df, names, order, by).select(by, F.to_json(F.struct(F.col("listed").alias(field))).alias("body"))


def _answer(ledger: Ledger, user: str, rows: DataFrame, names: dict[str, str], order: list[str], field: str, flags: DataFrame | None) -> DataFrame:
    """One row ``(user, body)`` whatever there is to list; with ``flags``, ``tainted`` beside the list."""
    asked = ledger.raw_fills.sparkSession.createDataFrame([(user,)], "user string")
    listed = _listed(rows, names, order, "user")
    out = asked.join(listed, "user", "left").withColumn("listed", F.coalesce("listed", F.array().cast(listed.schema["listed"].dataType)))
    fields = [F.col("listed").alias(field)]
    if flags is not None:
        out = out.join(flags, "user", "left")
        fields.append(F.coalesce("tainted", F.lit(False)).alias("tainted"))
    return out.select("user", F.to_json(F.struct(*fields)).alias("body"))


def trades(ledger: Ledger, user: str, builder_only: bool = False, **window) -> DataFrame:
    rows = reports.trades(ledger, user, builder_only=builder_only, **window).drop("tainted")
    flags = reports.trades_taint(ledger, user, **window) if builder_only else None
    return _answer(ledger, user, rows, TRADE, FILL_ORDER, "trades", flags)


def positions(ledger: Ledger, user: str, builder_only: bool = False, **window) -> DataFrame:
    rows = reports.position_history(ledger, user, builder_only=builder_only, **window)
    flags = reports.history_taint(ledger, user, **window) if builder_only else None
    return _answer(ledger, user, rows, POSITION, ["time_ms", "seq", "coin", "lifecycle_id"], "snapshots", flags)


def pnl(ledger: Ledger, user: str, builder_only: bool = False, **more) -> DataFrame:
    rows = reports.pnl(ledger, user, builder_only=builder_only, **more)
    return rows_json(rows, PNL | TAINTED if builder_only else PNL)


def leaderboard(ledger: Ledger, metric: str, **more) -> DataFrame:
    return rows_json(reports.leaderboard(ledger, metric, **more), BOARD | TAINTED)


def deposits(ledger: Ledger, user: str, **window) -> DataFrame:
    """``(user, body)`` with the totals beside the list."""
    rows = reports.deposits(ledger, user, **window)
    listed = _listed(rows, DEPOSIT, ["time_ms", "event_key"], "user")
    out = reports.deposit_totals(ledger, user, **window).join(listed, "user", "left")
    none = F.array().cast(listed.schema["listed"].dataType)
    body = F.struct(decimal_text(F.col("total_deposits")).alias("totalDeposits"), F.col("deposit_count").alias("depositCount"), F.coalesce("listed", none).alias("deposits"))
    return out.select("user", F.to_json(body).alias("body"))


def risk(margin_reports: DataFrame, column: str, user: str) -> DataFrame:
    """``(user, body)`` of the wallet's margin reports; an unknown liquidation price is null in it."""
    found = reports.risk(margin_reports, column, user)
    entry = lambda p: F.struct(*[(decimal_text(p[c]) if c == "size" else p[c]).alias(n) for c, n in RISK.items()])
    summary = F.struct(*[F.col(f"summary.{c}").alias(n) for c, n in MARGIN.items()])
    body = F.struct(F.transform("positions", entry).alias("positions"), summary.alias("crossMarginSummary"))
    return found.select("user", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def health() -> str:
    return json.dumps({"status": "ok"})


def ready() -> str:
    return json.dumps({"status": "ready"})
