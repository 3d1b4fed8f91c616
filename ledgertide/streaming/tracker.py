"""Positions from a stream of fills that arrive late, out of order and more than once."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgertide.operators.positions import next_average
from ledgertide.plans.compile import BUCKETS, ingest
from ledgertide.schema import AVERAGE, NET
from ledgertide.sources.sinks import append_new

#: What may arrive so much later than the newest fill is still put in its place by ``positions``.
LOOKBACK = "24 hours"
OUT = f"user string, coin string, time_ms long, fill_key string, kind string, net_size {NET}, avg_entry_px {AVERAGE}, opener string"
HELD = "net string, avg string, opener string"
WAITING = "t long, tid long, oid long, key string, side string, px string, sz string"
#: The state store that lists in the state need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def positions(fills: DataFrame, lookback: str = LOOKBACK) -> DataFrame:
    """The position of a wallet and coin after each fill, once no earlier fill can come any more.

    Repeated fill keys are dropped within the watermark. Each (user, coin) keeps its net size, average
    entry and opening fill in the state store, and a list of the fills the watermark hasn't passed, to
    which arriving fills are appended; a timer at the earliest of them folds in what the watermark has
    passed, in the order of time, tid, oid and key. The session's state store is set to RocksDB, as lists
    need it. Fills later than
    ``lookback`` are dropped here (``numRowsDroppedByWatermark`` in the query's progress counts them), and
    the later rows of their wallet and coin are without them: start :func:`follow` on the same source,
    which has them all. A restart goes on from the checkpoint: no position starts from empty.
    """
    rows = fills.select("user", "coin", "time_ms", "side", "px", "sz", "tid", "oid", "fill_key").withColumn("at", F.timestamp_millis("time_ms"))
    once = rows.withWatermark("at", lookback).dropDuplicatesWithinWatermark(["fill_key"])
    texts = once.select("user", "coin", "time_ms", "side", F.col("px").cast("string").alias("px"), F.col("sz").cast("string").alias("sz"), "tid", "oid", "fill_key", "at")
    fills.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return texts.groupBy("user", "coin").transformWithStateInPandas(_Positions(), OUT, "Append", "EventTime")


def _place(fill: tuple) -> tuple:
    missing_first = lambda v: (v is not None, v or 0)
    return fill[0], missing_first(fill[1]), missing_first(fill[2]), fill[3]


def kind_of(prev: Decimal, net: Decimal) -> str:
    if prev * net < 0:
        return "flip"
    if prev == 0:
        return "none" if net == 0 else "open"
    if net == 0:
        return "close"
    return "increase" if abs(net) > abs(prev) else "decrease"


class _Positions(StatefulProcessor):
    """The position of one wallet and coin, and its fills that wait for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = lambda v: None if pd.isna(v) else int(v)
        fills = [(int(r.time_ms), whole(r.tid), whole(r.oid), r.fill_key, r.side, r.px, r.sz) for b in rows for r in b.itertuples(index=False)]
        self.waiting.appendList(fills)
        yield from self._passed(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._passed(key, timerValues)

    def close(self) -> None:
        pass

    def _passed(self, key: tuple, timers) -> Iterator[pd.DataFrame]:
        """Fold in the waiting fills that the watermark has passed and set a timer for the others."""
        passed = timers.getCurrentWatermarkInMs()
        fills = [tuple(f) for f in self.waiting.get()]
        ready, later = [f for f in fills if f[0] <= passed], [f for f in fills if f[0] > passed]
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if later:
            self.handle.registerTimer(max(min(f[0] for f in later), passed) + 1)
        if not ready:
            return
        state = self.held.get() if self.held.exists() else ("0", "0", None)
        net, avg, opener = Decimal(state[0]), Decimal(state[1]), state[2]
        out = []
        for t, _, _, fill_key, side, px, sz in sorted(ready, key=_place):
            price, size = Decimal(px or 0), Decimal(sz or 0)
            prev, net = net, net + (-size if side == "sell" else size)
            kind = kind_of(prev, net)
            if kind == "none":
                continue
            avg = next_average(kind, avg, prev, net, price)
            opener = fill_key if kind in ("open", "flip") else opener
            out.append((key[0], key[1], t, fill_key, kind, net, avg.quantize(Decimal(1).scaleb(-12)), opener))
        self.held.update((str(net), str(avg), opener))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def follow(fills: DataFrame, folder: str, checkpoint: str, available_now: bool = True, buckets: int = BUCKETS):
    """Keep the fills of a stream stored in ``folder``, and lifecycles, effects and snapshots with them, however late a fill is.

    There is no watermark: each batch goes to :func:`ledgertide.plans.compile.ingest`, which recompiles the
    buckets of its wallets and coins from all stored fills. So a fill that lies any time behind the newest
    corrects the rows after it, and the tables don't depend on where batches end. Replayed batches change
    nothing. A batch costs a reading of its buckets' history, so batches should be large.
    """
    writer = fills.writeStream.foreachBatch(lambda batch, _: ingest(batch, folder, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def store_fills(fills: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Keep appending the fills of a stream that aren't stored yet; replayed batches change nothing."""
    writer = fills.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, "fill_key", "id")).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
