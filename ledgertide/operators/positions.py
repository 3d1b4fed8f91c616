"""Positions of each wallet and coin after every fill, their lifecycles, effects and average entry."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.functions.keys import lifecycle_id, sign_of
from ledgertide.operators.sliced import SLICE_MS, before_here, carried, in_slice, upto_here, with_slice
from ledgertide.operators.storage import written
from ledgertide.schema import AVERAGE, FILL_ORDER, MONEY, NET, NOTIONAL


def transitions(fills: DataFrame, with_openers: bool = True) -> DataFrame:
    """``fills`` with ``prev`` and ``net`` size, ``kind``, and the opening fills ``opener`` and ``closer``.

    In the order of time, tid, oid and key (nulls first), ``kind`` is ``open`` (from flat), ``close`` (to
    flat), ``flip`` (through flat), ``increase``, ``decrease``, or ``none`` for a size of zero while flat.
    ``opener`` is the key of the fill that opened the position held afterwards (at a close: just before);
    ``closer``, of a flip, the one that had opened the position it closed.

    The rows are brought together once by wallet, coin and slice of time, so a busy wallet isn't one task;
    the running sum and the last opener within a slice come from one sort there. What a slice starts with
    is carried from the slices before it: the size held from sums that are folded before they are shuffled,
    the opener from the written last rows of the slices. A null size counts as zero. Where ``with_openers`` is off, ``opener`` and ``closer`` are left out,
    and nothing is written.
    """
    signed = (F.coalesce("sz", F.lit(0)) * sign_of(F.col("side"))).cast("decimal(19,8)")
    rows = with_slice(fills.withColumn("signed", signed), ["user", "coin"], "time_ms")
    rows = carried(rows, {"moved": F.sum("signed")}, {"held": F.sum("moved")})
    rows = rows.withColumn("net", (F.coalesce("held", F.lit(0)) + F.sum("signed").over(upto_here(*FILL_ORDER))).cast(NET))
    rows = rows.withColumn("prev", (F.col("net") - F.col("signed")).cast(NET))
    prev, net = F.col("prev"), F.col("net")
    kind = (
        F.when(F.signum(prev) * F.signum(net) < 0, "flip")
        .when((prev == 0) & (net == 0), "none")
        .when(prev == 0, "open")
        .when(net == 0, "close")
        .when(F.abs(net) > F.abs(prev), "increase")
        .otherwise("decrease")
    )
    rows = rows.withColumn("kind", kind)
    if not with_openers:
        return rows.select(*fills.columns, "prev", "net", "kind")
    rows = rows.withColumn("opens", F.when(F.col("kind").isin("open", "flip"), F.col("fill_key")))
    here = F.last("opens", ignorenulls=True).over(upto_here(*FILL_ORDER))
    before = F.last("opens", ignorenulls=True).over(before_here(*FILL_ORDER))
    last = F.lead(F.lit(1)).over(in_slice(*FILL_ORDER)).isNull()
    rows = written(rows.withColumns({"here": here, "before": before, "is_last": last}).drop("opens", "held", "signed"), "net")
    rows = carried(rows, {"last_opens": "here"}, {"opened": F.last("last_opens", ignorenulls=True)}, F.col("is_last"))
    opener, closer = F.coalesce("here", "opened"), F.coalesce("before", "opened")
    return rows.select(
        *fills.columns, "prev", "net", "kind", F.when(F.col("kind") != "none", opener).alias("opener"), F.when(F.col("kind") == "flip", closer).alias("closer")
    )


def effects(moves: DataFrame) -> DataFrame:
    """One row per effect of a fill: a flip closes one lifecycle and opens another, any other fill has one.

    A flip's fee is split in proportion to the sizes, the closing part cut to eight digits; all its
    closed_pnl goes to the closing part. ``part`` is 1 for the opening part of a flip, else 0. Fills of kind
    ``none`` have no effect.
    """
    closed, units = F.abs("prev").cast("decimal(18,8)"), 100_000_000
    share = F.expr("(cast(fee * 100000000 as decimal(20,0)) * cast(abs(prev) * 100000000 as decimal(18,0))) div cast(sz * 100000000 as decimal(18,0))")
    closing_fee = (share.cast("decimal(20,0)") / F.lit(units).cast("decimal(9,0)")).cast(MONEY)
    zero = F.lit(0).cast(MONEY)

    def effect(kind: str, opener: str, qty, fee, pnl, part: int = 0):
        qty = qty.cast("decimal(18,8)")
        return F.struct(
            F.lit(part).alias("part"),
            F.lit(kind).alias("effect_type"),
            lifecycle_id(F.col(opener)).alias("lifecycle_id"),
            qty.alias("qty"),
            (F.col("px") * qty).cast(NOTIONAL).alias("notional"),
            fee.cast(MONEY).alias("fee"),
            pnl.cast(MONEY).alias("closed_pnl"),
        )

    flipped = F.array(
        effect("close", "closer", closed, closing_fee, F.col("closed_pnl")),
        effect("open", "opener", F.abs("net"), F.col("fee") - closing_fee, zero, 1),
    )
    opening = F.array(effect("open", "opener", F.col("sz"), F.col("fee"), F.col("closed_pnl")))
    lowering = F.array(effect("close", "opener", F.col("sz"), F.col("fee"), F.col("closed_pnl")))
    each = F.when(F.col("kind") == "flip", flipped).when(F.col("kind").isin("open", "increase"), opening).otherwise(lowering)
    rows = moves.where(F.col("kind") != "none").select("fill_key", "user", "coin", "time_ms", F.explode(each).alias("e"))
    return rows.select("fill_key", "user", "coin", "time_ms", "e.*")


def lifecycles(moves: DataFrame) -> DataFrame:
    """``(id, user, coin, start_time_ms, end_time_ms)``: from flat to flat, the end null while open."""
    started = F.when(F.col("kind").isin("open", "flip"), F.struct("opener", F.col("time_ms").alias("start"), F.lit(None).cast("long").alias("end")))
    ended = F.when(
        F.col("kind").isin("close", "flip"),
        F.struct(F.coalesce("closer", "opener").alias("opener"), F.lit(None).cast("long").alias("start"), F.col("time_ms").alias("end")),
    )
    rows = moves.select("user", "coin", F.explode(F.array_compact(F.array(started, ended))).alias("e"))
    out = rows.groupBy("user", "coin", "e.opener").agg(F.max("e.start").alias("start_time_ms"), F.max("e.end").alias("end_time_ms"))
    return out.select(lifecycle_id(F.col("opener")).alias("id"), "user", "coin", "start_time_ms", "end_time_ms")


def snapshots(moves: DataFrame) -> DataFrame:
    """``(user, coin, time_ms, seq, net_size, avg_entry_px, lifecycle_id, fill_key)`` after every fill.

    A flip has two: flat at the end of the old lifecycle (seq 0), and the new position (seq 1). The
    average entry price is that of the last opening, weighted in by every increase and kept by every
    decrease, in decimals of 28 digits.

    An average depends on the one before it, but as a linear map of it, ``a * average + b``, and such maps
    can be joined. So a lifecycle is worked on in slices of time: each slice gives the map from what it
    starts with to each of its rows, the slices' own maps are joined in order, and their ends are put in.
    A lifecycle that never ends is as many tasks as it has slices. Maps are kept in 64-bit mantissas.
    """
    rows = moves.where(F.col("kind") != "none").select("user", "coin", *[c for c in FILL_ORDER], "opener", "closer", "kind", "prev", "net", "px")
    # a binary number for the whole part and one for the hundred-millionths hold a decimal as it is
    measures = {"before": F.abs("prev"), "after": F.abs("net"), "price": F.coalesce("px", F.lit(0))}
    whole = {f"{n}_whole": F.floor(c).cast("double") for n, c in measures.items()}
    units = {f"{n}_units": ((c - F.floor(c)) * 100_000_000).cast("double") for n, c in measures.items()}
    rows = rows.withColumns({"slice": F.floor(F.col("time_ms") / SLICE_MS), **whole, **units})
    life = ["user", "coin", "opener"]
    # by hash first: a number is sorted faster than texts
    ordered = rows.repartition(*life, "slice").sortWithinPartitions(F.xxhash64(*life), *life, "slice", *FILL_ORDER)
    kept = [c for c in rows.columns if c not in _DROPPED]
    no_map = [F.lit(0).cast("long").alias(c) for c in _MAP] + [F.lit(False).alias("is_last")]
    mapped = written(ordered.mapInArrow(_maps_by_row, rows.select(*kept, *no_map).schema), "maps")

    ends = mapped.where("is_last").select(*life, "slice", *_MAP).repartition(*life).sortWithinPartitions(*life, "slice")
    starts = ends.mapInArrow(_maps_by_slice, ends.select(*[F.col(c).alias(f"{c}2") for c in [*life, "slice"]], F.lit(0).cast(AVERAGE).alias("start")).schema)
    same = F.col("user").eqNullSafe(F.col("user2")) & F.col("coin").eqNullSafe(F.col("coin2")) & (F.col("opener") == F.col("opener2")) & (F.col("slice") == F.col("slice2"))
    start = F.coalesce("start", F.lit(0)).cast("decimal(24,12)")
    part = lambda c: F.col(c).cast("decimal(10,0)") * start
    billionth = F.lit(Decimal("0.000000001"))
    begun = (part("a_high") * billionth).cast("decimal(38,18)") + ((part("a_low") * billionth).cast("decimal(38,18)") * billionth).cast("decimal(38,18)")
    own = F.col("b_whole").cast("decimal(19,0)") + F.col("b_part").cast("decimal(19,0)") * F.lit(Decimal("0.000000000000000001"))
    folded = mapped.join(starts, same, "left").withColumn("avg_entry_px", F.round(own.cast("decimal(38,18)") + begun, 12).cast(AVERAGE))
    row = lambda seq, net, avg, opener: F.struct(F.lit(seq).alias("seq"), net.alias("net_size"), avg.alias("avg_entry_px"), lifecycle_id(opener).alias("lifecycle_id"))
    flat = row(0, F.lit(0).cast(NET), F.lit(0).cast(AVERAGE), F.col("closer"))
    after = lambda seq: row(seq, F.col("net"), F.col("avg_entry_px"), F.col("opener"))
    each = F.when(F.col("kind") == "flip", F.array(flat, after(1))).otherwise(F.array(after(0)))
    out = folded.select("user", "coin", "time_ms", "fill_key", F.explode(each).alias("s"))
    return out.select("user", "coin", "time_ms", "s.*", "fill_key")


def next_average(kind: str, avg: Decimal, prev: Decimal, net: Decimal, px: Decimal, context: Context = Context(prec=28)) -> Decimal:
    """The average entry price after a fill."""
    if kind in ("open", "flip"):
        return px
    if kind == "close":
        return Decimal(0)
    if kind == "increase":
        added = context.multiply(context.subtract(abs(net), abs(prev)), px)
        return context.divide(context.add(context.multiply(abs(prev), avg), added), abs(net))
    return avg


_DROPPED = ["prev", "px", *[f"{n}_{part}" for n in ("before", "after", "price") for part in ("whole", "units")]]
#: A map between steps: a in billionths and their billionths, b as whole number and 10^-18 parts.
_MAP = ["a_high", "a_low", "b_whole", "b_part"]


def _joined(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps ``x -> a * x + b`` of each run joined from its first (``first``) up to each row, in log steps."""
    a, b, n = a.copy(), b.copy(), len(a)
    at = np.arange(n)
    into = at - np.maximum.accumulate(np.where(first, at, 0))  # rows since the run's first
    step = 1
    while step < n and (far := np.flatnonzero(into >= step)).size:
        near = far - step
        a_new, b_new = a[far] * a[near], a[far] * b[near] + b[far]
        a[far], b[far] = a_new, b_new
        step *= 2
    return a, b


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it in any column; nulls are equal."""
    first = np.ones(len(columns[0]), bool)
    if len(first) > 1:
        same = np.ones(len(first) - 1, bool)
        for c in columns:
            equal = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            both = pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])).to_numpy(zero_copy_only=False)
            same &= equal | both
        first[1:] = ~same
    return first


def _coded(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    high = np.floor(a * 10**9)
    whole = np.floor(b)
    parts = (high, np.rint((a * 10**9 - high) * 10**9), whole, np.rint((b - whole) * 10**18))
    return [pa.array(p.astype(np.int64)) for p in parts]


def _decoded(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    high, low, whole, part = (b.column(c).to_numpy().astype(np.longdouble) for c in _MAP)
    return (high + low / 10**9) / 10**9, whole + part / 10**18


class _Carry:
    """The joined map at the end of the last batch, put before the first run of the next if that goes on."""

    def __init__(self) -> None:
        self.key, self.a, self.b = None, np.longdouble(1), np.longdouble(0)

    def over(self, keys: list[pa.Array], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = _runs(keys)
        a, b = _joined(first, a, b)
        if self.key == tuple(k[0].as_py() for k in keys):
            run = slice(0, (np.flatnonzero(first[1:])[:1] + 1).tolist()[0] if first[1:].any() else None)
            a[run], b[run] = a[run] * self.a, a[run] * self.b + b[run]
            first[0] = False
        self.key, self.a, self.b = tuple(k[-1].as_py() for k in keys), a[-1], b[-1]
        return first, a, b


def _maps_by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From what a slice of a lifecycle starts with to the average after each of its rows."""
    carry, held = _Carry(), None
    for b in batches:
        if not b.num_rows:
            continue
        before, after, price = (b.column(f"{c}_whole").to_numpy() + b.column(f"{c}_units").to_numpy() / np.longdouble(100_000_000) for c in ("before", "after", "price"))
        kind = b.column("kind")
        is_in = lambda *names: pc.is_in(kind, pa.array(names)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        share = np.where(is_in("increase"), before / np.where(after > 0, after, 1), np.where(is_in("decrease"), 1, 0)).astype(np.longdouble)
        added = np.where(is_in("increase"), (after - before) * price / np.where(after > 0, after, 1), np.where(is_in("open", "flip"), price, 0)).astype(np.longdouble)
        first, a, c = carry.over([b.column(n) for n in ("user", "coin", "opener", "slice")], share, added)
        names = [n for n in b.schema.names if n not in _DROPPED]
        columns = [*[b.column(n) for n in names], *_coded(a, c)]
        if held is not None:  # the last row of a batch is known to be its slice's last only now
            yield pa.RecordBatch.from_arrays([*held, pa.array([bool(first[0])])], names=[*names, *_MAP, "is_last"])
        ends = pa.array(first[1:])
        yield pa.RecordBatch.from_arrays([*[x[:-1] for x in columns], ends], names=[*names, *_MAP, "is_last"])
        held = [x[-1:] for x in columns]
    if held is not None:
        yield pa.RecordBatch.from_arrays([*held, pa.array([True])], names=[*names, *_MAP, "is_last"])


def _maps_by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The average each slice of a lifecycle starts with: the maps of those before it, from zero."""
    carry, last = _Carry(), np.longdouble(0)
    for b in batches:
        if not b.num_rows:
            continue
        names = ["user", "coin", "opener", "slice"]
        first, _, average = carry.over([b.column(n) for n in names[:3]], *_decoded(b))
        start = np.r_[last, average[:-1]]
        start[first] = 0
        last = average[-1]
        text = pa.array([np.format_float_positional(v, precision=12, unique=False) for v in start])
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], text.cast(pa.decimal128(28, 12))], names=[*[f"{n}2" for n in names], "start"])
