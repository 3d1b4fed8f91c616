"""The ledger queries over the stored tables, for all wallets at once."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.functions import keys
from ledgertide.operators import attribution, equity, positions
from ledgertide.operators.dedup import new_rows
from ledgertide.plans import api, reports
from ledgertide.plans.reports import Ledger
from ledgertide.schema import MONEY, NOTIONAL, TOTAL
from ledgertide.sources import feeds
from ledgertide.sources.tables import table, text_fills

#: The window of the windowed queries: three days of the week, both ends inclusive.
FROM_MS, TO_MS = 1_704_153_600_000, 1_704_412_800_000
CAP = "1000"
BUILDER = "0x307b1b74611670a44451db1ea49392400459402a"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(plan: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
    QUERIES[plan.__name__] = lambda spark, folder: plan(ledger(spark, folder))
    return plan


def ledger(spark: SparkSession, folder: str) -> Ledger:
    return Ledger(
        table(spark, folder, "raw_fills").drop("created_at"),
        table(spark, folder, "fill_attributions"),
        table(spark, folder, "deposits"),
    )



# --- fills and keys


@query
def fill_dedup(t: Ledger) -> DataFrame:
    return t.first_fills()


@query
def trades_ordered(t: Ledger) -> DataFrame:
    return reports.trades(t, with_builder=False).orderBy("time_ms", "tid", "oid", "fill_key")


@query
def trades_with_builder(t: Ledger) -> DataFrame:
    return reports.trades(t, from_ms=FROM_MS, to_ms=TO_MS).select("fill_key", "builder")


@query
def trades_builder_only(t: Ledger) -> DataFrame:
    return reports.trades(t, builder_only=True).select("user", "fill_key", "builder", "tainted")


@query
def trades_json(t: Ledger) -> DataFrame:
    return api.rows_json(reports.trades(t, from_ms=FROM_MS, to_ms=TO_MS), api.TRADE)


@query
def stored_texts(t: Ledger) -> DataFrame:
    """Fills stored as texts, some of them no numbers and some sides unknown."""
    spoilt = lambda c, way: F.when(F.pmod("id", F.lit(10)) == way, F.concat(F.lit("?"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string"))
    rows = t.raw_fills.withColumns({"px": spoilt("px", 1), "fee": spoilt("fee", 2), "builder_fee": spoilt("builder_fee", 3), "side": F.when(F.pmod("id", F.lit(10)) == 4, "SELL").otherwise(F.col("side"))})
    return text_fills(rows.withColumns({"sz": F.col("sz").cast("string"), "closed_pnl": F.col("closed_pnl").cast("string")})).select("id", "side", "px", "sz", "fee", "closed_pnl", "builder_fee")


@query
def trades_taint(t: Ledger) -> DataFrame:
    """Whether each wallet's listing of attributed fills leaves any out."""
    return reports.trades_taint(t, from_ms=FROM_MS, to_ms=TO_MS)


@query
def fill_keys_tid(t: Ledger) -> DataFrame:
    return t.raw_fills.where(F.col("tid").isNotNull()).select("id", keys.fill_key().alias("key"))


@query
def fill_keys_hash(t: Ledger) -> DataFrame:
    """Every row's key as if it had no tid."""
    return t.raw_fills.withColumn("tid", F.lit(None).cast("long")).select("id", keys.fill_key().alias("key"))


@query
def event_keys(t: Ledger) -> DataFrame:
    hashless = t.raw_deposits.withColumn("tx_hash", F.lit(None).cast("string"))
    return t.raw_deposits.select(keys.event_key().alias("key")).union(hashless.select(keys.event_key().alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query
def distinct_coins(t: Ledger) -> DataFrame:
    return t.raw_fills.select("user", "coin").distinct().orderBy("user", "coin")


@query
def day_partition(t: Ledger) -> DataFrame:
    return t.raw_fills.groupBy(keys.utc_day(F.col("time_ms")).alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query
def incremental_append(t: Ledger) -> DataFrame:
    """What the rows that arrived after the middle of the week add to those before."""
    early = F.col("time_ms") < 1_704_326_400_000
    return new_rows(t.raw_fills.where(~early), t.raw_fills.where(early), "fill_key", "id", ["user", "coin", "side"]).select("id", "fill_key")


# --- positions


@query
def position_net(t: Ledger) -> DataFrame:
    return positions.transitions(t.fills, with_openers=False).select("fill_key", "user", "coin", F.col("prev").cast(TOTAL).alias("prev"), F.col("net").cast(TOTAL).alias("net"))


@query
def position_transitions(t: Ledger) -> DataFrame:
    return t.moves_once().select("fill_key", "kind", "opener", "closer")


@query
def transition_counts(t: Ledger) -> DataFrame:
    return positions.transitions(t.fills, with_openers=False).groupBy("kind").agg(F.count(F.lit(1)).alias("fills"))


@query
def lifecycles(t: Ledger) -> DataFrame:
    return positions.lifecycles(t.moves_once())


@query
def effects_flip_split(t: Ledger) -> DataFrame:
    return positions.effects(t.moves_once()).select("fill_key", "effect_type", "lifecycle_id", "qty", F.col("notional").cast(NOTIONAL).alias("notional"), "fee", "closed_pnl")


@query
def snapshots_avg_entry(t: Ledger) -> DataFrame:
    """The average is cut to six digits, a little off the half, so that no price with few digits lies on an edge."""
    rows = positions.snapshots(t.moves_once())
    cut = F.floor((F.col("avg_entry_px") + F.lit(Decimal("0.000000318309"))) * 1_000_000).cast("decimal(28,0)") * F.lit(Decimal("0.000001"))
    return rows.select("user", "coin", "time_ms", "seq", F.col("net_size").cast(TOTAL).alias("net_size"), cut.cast("decimal(28,6)").alias("avg_entry_px"), "lifecycle_id", "fill_key")


@query
def snapshots_net(t: Ledger) -> DataFrame:
    rows = reports.position_history(t, from_ms=FROM_MS, to_ms=TO_MS)
    return rows.select("user", "coin", "time_ms", "seq", F.col("net_size").cast(TOTAL).alias("net_size"), "lifecycle_id", "fill_key")


@query
def snapshots_builder_only(t: Ledger) -> DataFrame:
    rows = reports.position_history(t, builder_only=True)
    return rows.select("user", "coin", "time_ms", "seq", F.col("net_size").cast(TOTAL).alias("net_size"), "lifecycle_id")


@query
def snapshots_taint(t: Ledger) -> DataFrame:
    """Whether each wallet's listing of clean lifecycles leaves any snapshot out."""
    return reports.history_taint(t, from_ms=FROM_MS, to_ms=TO_MS)


# --- profit and leaderboards


@query
def pnl_gross(t: Ledger) -> DataFrame:
    return reports.pnl(t)


@query
def pnl_net(t: Ledger) -> DataFrame:
    return reports.pnl(t, from_ms=0, pnl_mode="net").drop("return_pct")


@query
def pnl_all_wallets(t: Ledger) -> DataFrame:
    """From each wallet's first deposit; wallets without effects have zeros."""
    return reports.pnl(t, to_ms=TO_MS, users=t.wallets())


def pnl_with_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The starting equity is the latest reading where there is one; about a third of the wallets have none."""
    t = ledger(spark, folder)
    t.equity_snapshots = _readings(t, early=True).where(F.sha2("user", 256) >= "5")
    return reports.pnl(t)


@query
def pnl_window(t: Ledger) -> DataFrame:
    return reports.pnl(t, from_ms=FROM_MS, to_ms=TO_MS, max_start_capital=CAP)


@query
def pnl_builder_only(t: Ledger) -> DataFrame:
    return reports.pnl(t, from_ms=0, builder_only=True).drop("return_pct")


@query
def pnl_one_coin(t: Ledger) -> DataFrame:
    return reports.pnl(t, coin=" QRO ", from_ms=0).drop("return_pct")


@query
def leaderboard_volume(t: Ledger) -> DataFrame:
    return reports.leaderboard(t, "volume")


@query
def leaderboard_pnl(t: Ledger) -> DataFrame:
    return reports.leaderboard(t, "pnl", builder_only=True)


@query
def leaderboard_users(t: Ledger) -> DataFrame:
    """Of named wallets, one without any fill among them."""
    named = t.raw_fills.select("user").where(F.sha2("user", 256) < "4").distinct()
    nobody = t.raw_fills.sparkSession.createDataFrame([("nobody",)], "user string")
    return reports.leaderboard(t, "pnl", coin="QRO", from_ms=FROM_MS, users=named.unionByName(nobody))


@query
def leaderboard_return_pct(t: Ledger) -> DataFrame:
    return reports.leaderboard(t, "returnPct", from_ms=FROM_MS, to_ms=TO_MS)


@query
def leaderboard_capped(t: Ledger) -> DataFrame:
    return reports.leaderboard(t, "returnPct", from_ms=FROM_MS, to_ms=TO_MS, max_start_capital=CAP, pnl_mode="net")


# --- attribution and taint


@query
def attribution_heuristic(t: Ledger) -> DataFrame:
    return attribution.attributed(t.fills, None, "heuristic")


@query
def attribution_completed(t: Ledger) -> DataFrame:
    return t.attributions


def _by_logs(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: attribution.attributed(ledger(spark, folder).fills, table(spark, folder, "builder_logs"), mode, BUILDER)


def attribution_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Exact matches need a log with tids; here every fourth fill's own tid stands in for one."""
    fills = ledger(spark, folder).fills
    logs = fills.where(F.col("tid") % 4 == 0).select(keys.utc_day(F.col("time_ms")).alias("day"), "tid")
    return attribution.exact_matches(fills, logs)


def attribution_window(spark: SparkSession, folder: str) -> DataFrame:
    logs = table(spark, folder, "builder_logs")
    return reports.attribution_window(ledger(spark, folder), logs, "auto", BUILDER, from_ms=FROM_MS, to_ms=TO_MS)


QUERIES |= {
    "pnl_with_snapshots": pnl_with_snapshots,
    "attribution_window": attribution_window,
    "attribution_exact": attribution_exact,
    "attribution_fuzzy": lambda spark, folder: attribution.fuzzy_matches(ledger(spark, folder).fills, table(spark, folder, "builder_logs")),
    "attribution_logs": _by_logs("logs"),
    "attribution_auto": _by_logs("auto"),
}


@query
def taint_lifecycles(t: Ledger) -> DataFrame:
    return t.taints.select("lifecycle_id", "user", "coin", "is_tainted")


@query
def taint_reason(t: Ledger) -> DataFrame:
    return t.taints.where(F.col("is_tainted")).select("lifecycle_id", "user", "coin", "taint_reason")


# --- deposits and equity


@query
def deposits_window(t: Ledger) -> DataFrame:
    return reports.deposits(t, from_ms=FROM_MS, to_ms=TO_MS).orderBy("time_ms", "event_key")


@query
def deposits_total(t: Ledger) -> DataFrame:
    return reports.deposit_totals(t)


@query
def deposits_total_all(t: Ledger) -> DataFrame:
    """Of a window, for every wallet, zeros included."""
    return reports.deposit_totals(t, from_ms=FROM_MS, to_ms=TO_MS, users=t.wallets())


@query
def earliest_deposit(t: Ledger) -> DataFrame:
    return t.deposits.groupBy("user").agg(F.min("time_ms").alias("first_ms"))


@query
def equity_derived(t: Ledger) -> DataFrame:
    return equity.derived(t.deposits, positions.effects(t.moves_once()), FROM_MS)


def _readings(t: Ledger, early: bool = False) -> DataFrame:
    """Each deposit's amount as if it were a reading of the equity; ``early``, some time before it, by its key."""
    if early:
        at = F.col("time_ms") - 600_000 * (F.ascii(F.sha2("event_key", 256)) - 47)
        rows = t.deposits.select("user", at.cast("long").alias("time_ms"), F.col("time_ms").alias("id"), (F.col("amount") + 1).cast(MONEY).alias("equity"))
        return rows.groupBy("user", "time_ms", "id").agg(F.max("equity").alias("equity"))
    return t.deposits.groupBy("user", "time_ms").agg(F.max("amount").alias("equity")).withColumn("id", F.lit(0).cast("long"))


@query
def equity_snapshot(t: Ledger) -> DataFrame:
    return equity.latest_snapshot(_readings(t), TO_MS)


@query
def equity_asof(t: Ledger) -> DataFrame:
    """For each fill the amount last paid in or out before or at it."""
    return equity.as_of(t.fills.select("user", "time_ms", "fill_key"), _readings(t)).select("fill_key", "equity")


# --- records in JSON


@query
def json_fills(t: Ledger) -> DataFrame:
    """Every stored fill written as a feed record and read back; sides outside A and B are skipped."""
    text = t.raw_fills.select("user", "coin", "id", feeds.fill_as_json().alias("record"))
    return feeds.parsed_fills(text, "record").select("id", "user", "coin", "time_ms", "side", "px", "sz", "fee", "closed_pnl", "builder_fee", "tid", "oid")


@query
def json_deposits(t: Ledger) -> DataFrame:
    text = t.raw_deposits.select("user", feeds.deposit_as_json().alias("record"))
    return feeds.parsed_deposits(text, "record").select("user", "time_ms", "amount", "tx_hash", "event_key")


@query
def risk_parse(t: Ledger) -> DataFrame:
    """Each wallet's final positions written as a margin report and read back without the flat ones."""
    last = t.moves.groupBy("user", "coin").agg(F.max_by("net", F.struct("time_ms", "tid", "oid", "fill_key")).alias("szi"), F.max_by("px", F.struct("time_ms", "tid", "oid", "fill_key")).alias("px"))
    report = last.groupBy("user").agg(feeds.risk_as_json().alias("report"))
    return feeds.risk_positions(report, "report").select("user", "coin", "size", "entry_px", "leverage")


# --- records of which some can't be read


def _spoilt(record: Column, by: Column, ways: list[Column]) -> Column:
    """``record``, of every tenth row in each of ``ways`` instead; ``by`` deals the rows."""
    out = record
    for i, way in enumerate(ways):
        out = F.when(F.pmod(by, F.lit(10)) == i, way).otherwise(out)
    return out


@query
def json_fills_mixed(t: Ledger) -> DataFrame:
    """Half of the records are spoilt, each tenth in its own way, and skipped; a bad builder fee is only left out."""
    record = feeds.fill_as_json()
    swap = lambda old, new: F.regexp_replace(record, old, new)
    ways = [swap('"side":"."', '"side":"X"'), swap('"px":"[^"]*",', ""), swap('"sz":"[^"]*"', '"sz":"1e3"'), swap('"time":', '"at":'), F.substring(record, 1, 20), swap('"builderFee":"[^"]*"', '"builderFee":"none"')]
    text = t.raw_fills.select("user", "coin", "id", _spoilt(record, F.col("id"), ways).alias("record"))
    return feeds.parsed_fills(text, "record").select("id", "user", "coin", "time_ms", "side", "px", "sz", "fee", "closed_pnl", "builder_fee", "tid", "oid")


@query
def json_deposits_mixed(t: Ledger) -> DataFrame:
    """Every shape a deposit comes in, and shapes that are no deposit, dealt by time."""
    amount, time, quote = F.col("amount").cast("string"), F.col("time_ms").cast("string"), F.lit('"')
    shape = lambda *parts: F.concat(F.lit('{"time":'), time, F.lit(","), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("}"))
    ways = [
        shape('"delta":', quote, amount, quote),
        shape('"amount":', quote, amount, quote),
        shape('"type":"transfer","amount":', quote, amount, quote),
        shape('"delta":{"usdc":', quote, amount, quote, "}"),
        shape('"delta":{"type":"transfer","usdc":', quote, amount, quote, "}"),
        shape('"delta":{"type":"deposit"},"amount":', quote, amount, quote),
        shape('"amount":', amount),
        shape('"delta":null,"amount":', quote, amount, quote),
        F.replace(shape('"amount":', quote, amount, quote), F.lit('"time":'), F.lit('"time":"",  "at":')),
    ]
    text = t.deposits.select("user", _spoilt(feeds.deposit_as_json(), F.col("time_ms"), ways).alias("record"))
    return feeds.parsed_deposits(text, "record").select("user", "time_ms", "amount", "tx_hash", "event_key")


@query
def risk_mixed(t: Ledger) -> DataFrame:
    """Margin reports of deposits, some without a summary, some with positions that can't be read."""
    amount = F.col("amount").cast("string")
    position = lambda size, more="": F.concat(F.lit('{"position":{"coin":"A","szi":"'), size, F.lit('"' + more + "}}"))
    entries = F.concat_ws(",", position(amount, ',"leverage":{"type":"cross","value":"7"},"entryPx":"2.5"'), position(F.lit("0.00")), position(F.lit("many")), F.lit('{"x":1}'), position(F.lit("-1"), ',"leverage":"3"'))
    report = F.concat(F.lit('{"marginSummary":{"accountValue":"'), amount, F.lit('"},"withdrawable":"9","assetPositions":['), entries, F.lit("]}"))
    report = _spoilt(report, F.col("time_ms"), [F.replace(report, F.lit("marginSummary"), F.lit("summary")), F.lit("broken"), F.replace(report, F.lit("assetPositions"), F.lit("positions"))])
    rows = reports.risk(t.deposits.select(F.concat_ws(" ", "user", "event_key").alias("user"), report.alias("report")), "report")
    one = F.when(F.size("positions") > 0, F.col("positions")).otherwise(F.array(F.lit(None).cast(rows.schema["positions"].dataType.elementType)))
    return rows.select("user", "summary.account_value", "summary.withdrawable", F.explode(one).alias("p")).select(
        "user", "account_value", "withdrawable", F.col("p.coin").alias("coin"), F.col("p.size").alias("size"), F.col("p.entry_px").alias("entry_px"), F.col("p.leverage").alias("leverage")
    )
