"""Merging the time intervals of each entity into continuous periods, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.operators.sliced import before_here, carried, upto_here, with_slice
from ledgertide.operators.storage import written

#: Width of the slices in which a long history is worked on. After equal starts are merged a slice of six
#: hours holds at most 21.6 million rows of one entity, however many rows the entity has; they are sorted and stream past.
SLAB_MS = 6 * 3_600_000


def periods_and_gaps(
    df: DataFrame,
    entity: str,
    start: str,
    end: str,
    open_end: int,
    slab_ms: int = SLAB_MS,
) -> DataFrame:
    """``(kind, <entity>, start_ms, end_ms)``: the maximal periods and the gaps of each entity.

    Sorted by start, an interval opens a new period if its start is above the running maximum of the
    ends before it; the running count of openings is kept as the start of the period it belongs to, and
    the ends of a period are aggregated. The gap before an opening reaches from that running maximum to
    its start. Intervals that overlap or touch are one period.

    A history isn't sorted as one group. It is cut into slices of ``slab_ms``; the running maxima over
    the slices (one row each) are carried into the slices, so an entity with a third of all rows is
    spread over as many tasks as it has slices. Equal starts are merged before the first sort. Each slice
    is folded into its own periods, with the gaps before them; these are written, and what a slice holds
    of a period that opened before it is added to that period from the slices' rows.

    Nulls: a null ``end`` counts as ``open_end``; rows with a null ``start`` have no place in time and
    are ignored, as are rows that end before they start; a null entity is an entity of its own.
    Repeated rows change nothing. An interval without length is a period (without length) unless
    another one covers it. No rows in, no rows out. Other columns are not looked at.
    """
    source = df.select(
        F.col(entity).alias("k"),
        F.col(start).cast("long").alias("s"),
        F.coalesce(F.col(end).cast("long"), F.lit(open_end)).alias("e"),
    ).where(F.col("s").isNotNull() & (F.col("e") >= F.col("s")))
    rows = with_slice(source, ["k"], "s", slab_ms).groupBy("__key", "__slice", "s").agg(F.max("e").alias("e"))

    rows = carried(rows, {"top": F.max("e")}, {"earlier": F.max("top")})
    reached = F.greatest(F.max("e").over(before_here("s")), "earlier")
    rows = rows.withColumn("reached", reached)
    rows = rows.withColumn("opens", F.when(F.col("reached").isNull() | (F.col("s") > F.col("reached")), F.col("s")))
    rows = rows.withColumn("label", F.max("opens").over(upto_here("s")))
    # a slice's own periods, and without a label what belongs to the period that reaches into it
    before = F.max(F.when(F.col("opens").isNotNull(), F.col("reached")))
    parts = written(rows.groupBy("__key", "__slice", "label").agg(F.max("e").alias("till"), before.alias("gap_from")), "periods")

    earlier = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = parts.groupBy("__key", "__slice").agg(F.max("label").alias("last"), F.max(F.when(F.col("label").isNull(), F.col("till"))).alias("till"))
    reaching = slices.select("__key", F.max("last").over(earlier).alias("label"), "till", F.lit(None).cast("long").alias("gap_from")).where(F.col("till").isNotNull())
    own = parts.where(F.col("label").isNotNull()).select("__key", "label", "till", "gap_from")
    periods = own.unionByName(reaching).groupBy("__key", "label").agg(F.max("till").alias("till"), F.max("gap_from").alias("gap_from"))
    entry = lambda kind, begins, ends: F.struct(F.lit(kind).alias("kind"), F.col(begins).alias("start_ms"), F.col(ends).alias("end_ms"))
    gap = F.when(F.col("gap_from").isNotNull(), entry("gap", "gap_from", "label"))
    out = periods.select("__key", F.explode(F.array_compact(F.array(entry("period", "label", "till"), gap))).alias("p"))
    return out.select("p.kind", F.col("__key.k").alias(entity), "p.start_ms", "p.end_ms")
