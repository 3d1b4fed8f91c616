"""The report queries: trades, position history, profit, leaderboard, deposits.

Each takes and returns DataFrames and answers for all wallets at once; ``user`` narrows it to one, which
Catalyst pushes below the windows, as they are partitioned by it.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions.keys import tx_hash
from ledgertide.operators import attribution, equity, positions, taint
from ledgertide.operators.dedup import first_written
from ledgertide.operators.ranking import ranked
from ledgertide.operators.storage import written
from ledgertide.plans import params
from ledgertide.schema import TOTAL
from ledgertide.sources import feeds


def narrowed(df: DataFrame, user: str | None = None, coin: str | None = None, lo: int = 0, hi: int = params.MAX_MS) -> DataFrame:
    if user is not None:
        df = df.where(F.col("user") == user)
    if coin is not None:
        df = df.where(F.col("coin") == coin)
    if lo > 0 or hi < params.MAX_MS:
        df = df.where(F.col("time_ms").between(lo, hi))
    return df


@dataclass
class Ledger:
    """The stored tables and what follows from them, each built once."""

    raw_fills: DataFrame
    stored_attributions: DataFrame | None = None
    raw_deposits: DataFrame | None = None
    equity_snapshots: DataFrame | None = None

    def first_fills(self) -> DataFrame:
        """The first write of each fill. A fill's key holds its wallet and coin; its side never changes."""
        return first_written(self.raw_fills, "fill_key", "id", ["user", "coin", "side"])

    @cached_property
    def fills(self) -> DataFrame:
        """Written once: nothing that starts from the fills reads the stored copies or folds them again."""
        return written(self.first_fills(), "fills")

    @cached_property
    def attributed_fills(self) -> DataFrame:
        """Written once, for listings that need the attributed fills and whether there are others."""
        return written(attribution.attach(self.fills, self.stored_attributions), "attributed")

    @cached_property
    def attributions(self) -> DataFrame:
        """The stored attribution of each fill, else the one by its fee."""
        return attribution.completed(self.fills, self.stored_attributions)

    def wallets(self) -> DataFrame:
        """``(user)``: every wallet with a fill or a deposit."""
        named = self.raw_fills.select("user")
        if self.raw_deposits is not None:
            named = named.unionByName(self.raw_deposits.select("user"))
        return named.where(F.col("user").isNotNull()).distinct()

    @cached_property
    def moves(self) -> DataFrame:
        """Written once: effects, taints, equity and snapshots all start from it, without a shuffle."""
        return written(positions.transitions(self.fills), "moves")

    def moves_once(self) -> DataFrame:
        """The moves for a single use: read if they are written, else not written for it."""
        return self.moves if "moves" in self.__dict__ else positions.transitions(self.fills)

    @cached_property
    def effects(self) -> DataFrame:
        return positions.effects(self.moves)

    @cached_property
    def taints(self) -> DataFrame:
        """Taken from the moves: each fill's attribution is looked up once, whatever effects it has."""
        return taint.moves_taint(attribution.attach(self.moves, self.stored_attributions))

    @cached_property
    def deposits(self) -> DataFrame:
        """One row per event; copies may differ in the spelling of the hash, which comes out normalized."""
        hashed = self.raw_deposits.withColumn("tx_hash", tx_hash(F.col("tx_hash")))
        once = hashed.groupBy("event_key").agg(F.min("user").alias("user"), F.min("time_ms").alias("time_ms"), F.min("amount").alias("amount"), F.min("tx_hash").alias("tx_hash"))
        return written(once, "deposits")


def trades(
    ledger: Ledger, user: str | None = None, coin: str | None = None, from_ms: int | None = None, to_ms: int | None = None, builder_only: bool = False, with_builder: bool = True
) -> DataFrame:
    """Fills; ``builder`` is shown for attributed fills matched in the logs, unless ``with_builder`` is off.

    ``builder_only`` keeps the attributed fills and adds ``tainted``: whether the wallet has others in the
    window. Where all are left out see :func:`trades_taint`.
    """
    columns = ["user", "coin", "time_ms", "side", "px", "sz", "fee", "closed_pnl", "builder_fee", "tid", "oid", "fill_key"]
    if not with_builder and not builder_only:
        return _windowed(ledger.fills, user, coin, from_ms, to_ms).select(*columns)
    fills = ledger.attributed_fills if builder_only else attribution.attach(ledger.fills, ledger.stored_attributions)
    rows = _windowed(fills, user, coin, from_ms, to_ms)
    rows = rows.withColumn("builder", F.when(F.col("attributed") & (F.col("mode") == "logs"), F.col("builder")))
    if not builder_only:
        return rows.select(*columns, "builder")
    others = rows.groupBy("user").agg(F.bool_or(~F.col("attributed")).alias("tainted")).withColumnRenamed("user", "of_user")
    return rows.where("attributed").join(others, F.col("user").eqNullSafe(F.col("of_user"))).select(*columns, "builder", "tainted")


def _windowed(fills: DataFrame, user: str | None, coin: str | None, from_ms: int | None, to_ms: int | None) -> DataFrame:
    lo, hi = params.window(from_ms, to_ms, ordered=False)
    return narrowed(fills, params.optional_address(user), params.coin(coin), lo, hi)


def trades_taint(ledger: Ledger, user: str | None = None, coin: str | None = None, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """``(user, tainted)`` of the wallets with fills in the window: whether a listing of the builder's leaves any out."""
    rows = _windowed(ledger.attributed_fills, user, coin, from_ms, to_ms)
    return rows.groupBy("user").agg(F.bool_or(~F.col("attributed")).alias("tainted"))


def attribution_window(
    ledger: Ledger, logs: DataFrame | None, mode: str, builder: str | None = None, user: str | None = None, coin: str | None = None, from_ms: int | None = None, to_ms: int | None = None
) -> DataFrame:
    """Attributions of the fills of a window by ``mode`` (heuristic, logs or auto), see ``attribution.attributed``."""
    lo, hi = params.window(from_ms, to_ms)
    return attribution.attributed(narrowed(ledger.fills, params.optional_address(user), params.coin(coin), lo, hi), logs, mode, builder)


def position_history(ledger: Ledger, user: str | None = None, coin: str | None = None, from_ms: int | None = None, to_ms: int | None = None, builder_only: bool = False) -> DataFrame:
    """Snapshots after each fill; ``builder_only`` leaves out tainted lifecycles and adds ``tainted``, false.

    Whether a wallet's listing leaves any out says :func:`history_taint`.
    """
    user, coin = params.optional_address(user), params.coin(coin, blank="error")
    lo, hi = params.window(from_ms, to_ms)
    rows = narrowed(positions.snapshots(narrowed(ledger.moves, user, coin)), lo=lo, hi=hi)
    return taint.clean_effects(rows, narrowed(ledger.taints, user, coin)).withColumn("tainted", F.lit(False)) if builder_only else rows


def history_taint(ledger: Ledger, user: str | None = None, coin: str | None = None, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """``(user, tainted)`` of the wallets with snapshots in the window: whether any is of a tainted lifecycle."""
    user, coin = params.optional_address(user), params.coin(coin, blank="error")
    lo, hi = params.window(from_ms, to_ms)
    rows = narrowed(ledger.moves, user, coin, lo, hi).where(F.col("kind") != "none")
    rows = rows.select("user", "coin", F.explode(F.array_compact(F.array("opener", "closer"))).alias("opener"))
    bad = narrowed(ledger.taints, user, coin).where("is_tainted").select("user", "coin", "opener", "is_tainted")
    rows = rows.join(bad, ["user", "coin", "opener"], "left")
    return rows.groupBy("user").agg(F.coalesce(F.bool_or("is_tainted"), F.lit(False)).alias("tainted"))


def return_pct(realized: Column, capital: Column) -> Column:
    """Profit as a percentage of capital to six digits, cut; zero without capital."""
    whole = lambda c: (c * 100_000_000).cast("decimal(38,0)")
    scaled = (whole(realized) * F.lit(100_000_000).cast("decimal(9,0)")).cast("decimal(38,0)")
    nonzero = F.when(capital != 0, whole(capital))
    quotient = F.call_function("div", scaled, nonzero).cast("decimal(20,0)")
    return F.coalesce((quotient / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))


def _capped(equity_: Column, cap: Decimal | None) -> Column:
    return equity_ if cap is None else F.least(equity_, F.lit(cap).cast(TOTAL))


def _realized(pnl_mode: str) -> Column:
    if pnl_mode not in ("gross", "net"):
        raise params.BadRequest(f"unknown pnl mode {pnl_mode!r}")
    return F.col("pnl") - F.col("fees") if pnl_mode == "net" else F.col("pnl")


def _marked(ledger: Ledger, rows: DataFrame, builder_only: bool) -> DataFrame:
    """Effects with ``out``: whether they are of a tainted lifecycle and the builder's alone are asked for."""
    if not builder_only:
        return rows.withColumn("out", F.lit(False))
    bad = ledger.taints.where("is_tainted").select("lifecycle_id", "user", "coin", "is_tainted")
    return rows.join(bad, ["lifecycle_id", "user", "coin"], "left").withColumn("out", F.coalesce("is_tainted", F.lit(False)))


def pnl(
    ledger: Ledger,
    user: str | None = None,
    coin: str | None = None,
    from_ms: int | None = None,
    to_ms: int | None = None,
    builder_only: bool = False,
    max_start_capital: str | None = None,
    pnl_mode: str = "gross",
    users: DataFrame | None = None,
) -> DataFrame:
    """``(user, realized_pnl, fees_paid, trade_count, return_pct, tainted)`` per wallet.

    One row for each wallet of ``users``, or for ``user``, with zeros where it has no effects; without
    both, a row for each wallet that has effects. The trade count counts effects, a flip twice. Without
    ``from_ms`` a wallet's window opens at its first deposit (0 if it has none). The starting equity is that
    of the window's opening: the latest snapshot at or before it, else deposits up to and profits before it.
    If ``user``'s first deposit lies after ``to_ms`` the request is refused, as with ``from_ms``.
    """
    user, coin = params.optional_address(user), params.coin(coin, trim=True)
    lo, hi = params.window(from_ms, to_ms)
    cap, realized = params.capital(max_start_capital), _realized(pnl_mode)
    opening = F.lit(lo)
    rows = narrowed(ledger.effects, user)
    starts = None
    if ledger.raw_deposits is not None:
        starts = equity.at_opening(narrowed(ledger.deposits, user), lo if from_ms is not None else None)
        if from_ms is None and to_ms is not None and user is not None:
            first = starts.agg(F.min("opening")).first()[0]
            params.window(first, to_ms)
    if from_ms is None and starts is not None:
        opened = starts.select(F.col("user").alias("of_user"), "opening")
        rows = rows.join(opened, F.col("user") == F.col("of_user"), "left").withColumn("opening", F.coalesce("opening", F.lit(0)))
        opening = F.col("opening")
    in_window = (F.col("time_ms") >= opening) & (F.col("time_ms") <= hi) & (F.lit(True) if coin is None else F.col("coin") == coin)
    rows = _marked(ledger, rows.withColumns({"inside": in_window, "before": F.col("time_ms") < opening}), builder_only)
    kept = F.col("inside") & ~F.col("out")
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0)).cast(TOTAL)
    sums = rows.groupBy("user").agg(
        total("closed_pnl", kept).alias("pnl"),
        total("fee", kept).alias("fees"),
        F.count_if(kept).alias("trade_count"),
        F.bool_or(F.col("inside") & F.col("out")).alias("tainted"),
        total("closed_pnl", F.col("before")).alias("made"),
        F.count_if("inside").alias("effects"),
    )
    if users is not None or user is not None:
        named = users.select("user").distinct() if users is not None else ledger.raw_fills.sparkSession.createDataFrame([(user,)], "user string")
        sums = named.join(sums, "user", "left")
    else:
        sums = sums.where(F.col("effects") > 0)
    sums = _with_equity(sums, starts, ledger.equity_snapshots, lo if from_ms is not None or starts is None else None)
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    return sums.select("user", *[zero(c, TOTAL).alias(c) for c in ("pnl", "fees", "equity")], zero("trade_count", "long").alias("trade_count"), F.coalesce("tainted", F.lit(False)).alias("tainted")).select(
        "user",
        realized.cast(TOTAL).alias("realized_pnl"),
        F.col("fees").alias("fees_paid"),
        "trade_count",
        return_pct(realized.cast(TOTAL), _capped(F.col("equity"), cap)).alias("return_pct"),
        "tainted",
    )


def _with_equity(sums: DataFrame, starts: DataFrame | None, snapshots: DataFrame | None, at_ms: int | None) -> DataFrame:
    """``sums`` with ``equity`` at ``at_ms``, or without one at each wallet's ``opening`` in ``starts`` (0 if it has none)."""
    paid = F.lit(0).cast(TOTAL)
    if starts is not None:
        sums = sums.join(starts.select(F.col("user").alias("of_user"), "opening", "paid"), F.col("user") == F.col("of_user"), "left").drop("of_user")
        paid = F.coalesce("paid", paid)
    derived = (paid + F.coalesce("made", F.lit(0).cast(TOTAL))).cast(TOTAL)
    if snapshots is None:
        return sums.withColumn("equity", derived)
    if at_ms is None:
        asked = sums.select("user", F.coalesce("opening", F.lit(0)).alias("at_ms"))
        found = equity.snapshot_of_each(asked, snapshots)
    else:
        found = equity.latest_snapshot(snapshots, at_ms)
    found = found.select(F.col("user").alias("of_user"), F.col("equity").alias("stood"))
    return sums.join(found, F.col("user") == F.col("of_user"), "left").withColumn("equity", F.coalesce("stood", derived)).drop("of_user", "stood")


def leaderboard(
    ledger: Ledger,
    metric: str,
    coin: str | None = None,
    from_ms: int | None = None,
    to_ms: int | None = None,
    builder_only: bool = False,
    max_start_capital: str | None = None,
    pnl_mode: str = "gross",
    users: DataFrame | None = None,
) -> DataFrame:
    """``(rank, user, metric_value, trade_count, tainted)``, ranked by value, trade count, then user.

    ``users`` are the wallets to rank, those without effects at zero; without it all wallets with fills.
    The trade count counts distinct fills. Ranks are unique.
    """
    metric = params.metric(metric)
    coin = params.coin(coin, trim=True)
    lo, hi = params.window(from_ms, to_ms)
    cap = params.capital(max_start_capital)
    inside = F.col("time_ms").between(lo, hi) & (F.lit(True) if coin is None else F.col("coin") == coin)
    rows = ledger.effects.withColumns({"inside": inside, "before": F.col("time_ms") < lo})
    rows = _marked(ledger, rows if metric == "returnpct" else rows.where("inside"), builder_only)
    kept = F.col("inside") & ~F.col("out")
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    sums_of = {"v": total("notional", kept), "p": total("closed_pnl", kept), "f": total("fee", kept), "tainted": F.bool_or(F.col("inside") & F.col("out")), "made": total("closed_pnl", F.col("before"))}
    if builder_only:
        # one row per fill first, so that distinct fills are counted without a set per wallet
        rows = rows.groupBy("user", "fill_key").agg(*[c.alias(n) for n, c in sums_of.items()], F.bool_or(kept).alias("counts"))
        sums_of = {**{n: F.sum(n) for n in ("v", "p", "f", "made")}, "tainted": F.bool_or("tainted")}
        count = F.count_if("counts")
    else:
        count = F.count_if(kept & (F.col("part") == 0))  # both parts of a flip are kept, so its first one counts for both
    kinds = {"v": ("volume", "decimal(38,16)"), "p": ("pnl", TOTAL), "f": ("fees", TOTAL), "made": ("made", TOTAL)}
    sums = rows.groupBy("user").agg(*[sums_of[n].cast(k).alias(name) for n, (name, k) in kinds.items()], sums_of["tainted"].alias("tainted"), count.alias("trade_count"))
    names = (users if users is not None else ledger.raw_fills).select("user").distinct().where(F.col("user").isNotNull())
    board = names.join(sums, "user", "left").na.fill({"trade_count": 0}).withColumn("tainted", F.coalesce("tainted", F.lit(False)))
    zero = lambda n, kind: F.coalesce(n, F.lit(0)).cast(kind)
    realized = zero(_realized(pnl_mode), TOTAL)
    if metric == "volume":
        value = zero("volume", "decimal(38,16)")
    elif metric == "pnl":
        value = realized
    else:
        starts = equity.at_opening(ledger.deposits, lo) if ledger.raw_deposits is not None else None
        board = _with_equity(board, starts, ledger.equity_snapshots, lo)
        value = return_pct(realized, _capped(zero("equity", TOTAL), cap))
    board = board.select("user", value.alias("metric_value"), "trade_count", "tainted")
    return ranked(board, [F.desc("metric_value"), F.desc("trade_count"), F.asc("user")])


def deposits(ledger: Ledger, user: str | None = None, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    lo, hi = params.window(from_ms, to_ms)
    return narrowed(ledger.deposits, params.optional_address(user), None, lo, hi).select("user", "time_ms", "amount", "tx_hash", "event_key")


def deposit_totals(ledger: Ledger, user: str | None = None, from_ms: int | None = None, to_ms: int | None = None, users: DataFrame | None = None) -> DataFrame:
    """``(user, total_deposits, deposit_count)``: a row for each wallet of ``users``, or for ``user``, zero without deposits; without both for each wallet with deposits."""
    rows = deposits(ledger, user, from_ms, to_ms)
    sums = rows.groupBy("user").agg(F.sum("amount").cast(TOTAL).alias("total_deposits"), F.count(F.lit(1)).alias("deposit_count"))
    if users is None and user is None:
        return sums
    named = users.select("user").distinct() if users is not None else rows.sparkSession.createDataFrame([(user,)], "user string")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return named.join(sums, "user", "left").select("user", zero("total_deposits", TOTAL), zero("deposit_count", "long"))


def risk(reports: DataFrame, column: str, user: str | None = None) -> DataFrame:
    """``(user, positions, summary)`` from margin reports (``user`` and the JSON text in ``column``): open positions and account figures.

    Reports without ``marginSummary`` can't be answered and are left out.
    """
    if user is not None:
        params.wallet_like(user)
        reports = reports.where(F.col("user") == user)
    return feeds.risk_report(reports.select("user", column), column)
