"""Exact percentiles per group from partial counts, by a full distributed sort."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgertide.operators.storage import small_or_shuffled, written

#: Percentiles are given in millionths, so that positions are whole-number arithmetic at any count.
UNIT = 1_000_000
MAX_BROADCAST_POINTS = 200_000


def partial_counts(df: DataFrame, group: str, fields: list[str], part: str, key: str | None = None) -> DataFrame:
    """``(part, group, field, value, n)``: how often each value of each field occurs in each part.

    The partial result of one part, a day say. Partials of any parts, made at any time, are combined by
    ``unionByName``; nothing is rounded, so the error of a percentile taken from them is zero.

    With ``key``, the rows of one key count once. Copies must agree in ``group`` and ``part``, so that
    every copy of a key falls into the same part; where their fields differ the smallest stands. A null
    key identifies nothing: each such row counts. Null values are not counted; a null group or part is
    one of its own. An empty table has no partials.
    """
    rows = df.select(
        F.col(part).alias("part"),
        F.col(group).alias("group"),
        *[F.col(f).alias(f"value_{i}") for i, f in enumerate(fields)],
        *([F.col(key).alias("key")] if key else []),
    )
    if key:
        rows = rows.withColumn("keyless", F.when(F.col("key").isNull(), F.monotonically_increasing_id()))
        rows = rows.groupBy("key", "keyless", "part", "group").agg(*[F.min(f"value_{i}").alias(f"value_{i}") for i in range(len(fields))])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"value_{i}").alias("value")) for i, f in enumerate(fields)])
    long = rows.select("part", "group", F.explode(pairs).alias("pair")).select("part", "group", "pair.field", "pair.value")
    return long.where(F.col("value").isNotNull()).groupBy("part", "group", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def percentiles(partials: DataFrame, probs: Iterable[float | str | Decimal]) -> DataFrame:
    """``(group, field, p, n, value)`` from partial counts: each percentile ``p`` of each group and field.

    All values are range-partitioned and sorted by (group, field, value) over the whole cluster, so a
    group of any size is spread over as many tasks as it fills. Each task numbers its own rows; the
    counts per task and group, added up in task order, are the offsets; a target position ``p * (n - 1)``
    is then located in exactly one task, and the two order statistics beside it are interpolated.

    ``n`` is the number of values; ``value`` is a decimal, free of rounding, for decimals of up to 24
    digits and a double for other numbers. Equal values come in as one row per part, so ties cost
    nothing. A single value is each of its percentiles.
    """
    millionths = [int(Decimal(str(p)) * UNIT) for p in probs]
    kind, value_kind = partials.schema["group"].dataType, partials.schema["value"].dataType
    ordered = partials.select("group", "field", "value", "n").repartitionByRange("group", "field", "value").sortWithinPartitions("group", "field", "value")
    schema = T.StructType(
        [
            T.StructField("task", T.IntegerType()),
            T.StructField("group", kind),
            T.StructField("field", T.StringType()),
            T.StructField("value", value_kind),
            T.StructField("n", T.LongType()),
            T.StructField("upto", T.LongType()),
        ]
    )
    counted = ordered.mapInArrow(_running_counts, schema)
    ranked = written(counted, "ranked")

    slices = ranked.groupBy("task", "group", "field").agg(F.max("upto").alias("rows"))
    whole = Window.partitionBy("group", "field")
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("total", F.sum("rows").over(whole)).withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    at = F.col("p") * (F.col("total") - 1)
    points = (
        slices.withColumn("p", F.explode(F.array(*[F.lit(m).cast("long") for m in millionths])))
        .withColumn("left", F.expr(f"(p * (total - 1)) div {UNIT}"))
        .withColumn("weight", at % UNIT)
        .withColumn("rank", F.explode(F.when(F.col("weight") > 0, F.array(F.col("left"), F.col("left") + 1)).otherwise(F.array("left"))))
        .where((F.col("rank") >= F.col("offset")) & (F.col("rank") < F.col("offset") + F.col("rows")))
        .select(
            F.col("task").alias("t"), F.col("group").alias("g"), F.col("field").alias("f"),
            "p", "total", "weight", (F.col("rank") == F.col("left")).alias("is_left"), (F.col("rank") - F.col("offset")).alias("within"),
        )
    )
    points = written(points, "points")
    same = (F.col("task") == F.col("t")) & F.col("group").eqNullSafe(F.col("g")) & (F.col("field") == F.col("f"))
    hit = (F.col("within") < F.col("upto")) & (F.col("within") >= F.col("upto") - F.col("n"))
    found = ranked.join(small_or_shuffled(points, MAX_BROADCAST_POINTS), same & hit)
    lower, upper = F.max(F.when(F.col("is_left"), F.col("value"))), F.max(F.when(~F.col("is_left"), F.col("value")))
    if isinstance(value_kind, T.DecimalType):
        share = F.col("weight").cast("decimal(7,0)")
        value = (lower * (F.lit(UNIT).cast("decimal(7,0)") - share) + F.coalesce(upper, lower) * share) * F.lit(Decimal(1) / UNIT)
    else:
        value = lower + F.coalesce((upper - lower) * F.col("weight") / UNIT, F.lit(0.0))
    return found.groupBy("group", "field", "p", "total", "weight").agg(value.alias("value")).select(
        "group", "field", (F.col("p") / UNIT).alias("p"), F.col("total").alias("n"), "value"
    )


def _running_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the task's number and, within each (group, field) of the sorted task, the running count."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    last, reached = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        group, field, n = b.column("group"), b.column("field"), b.column("n").to_numpy()
        total = n.cumsum()
        changed = [pc.fill_null(pc.not_equal(c[1:], c[:-1]), False) for c in (group, field)]
        changed.append(pc.not_equal(pc.is_null(group)[1:], pc.is_null(group)[:-1]))
        starts = pc.or_(pc.or_(changed[0], changed[1]), changed[2]).to_numpy(zero_copy_only=False).nonzero()[0] + 1
        first = (group[0].as_py(), field[0].as_py())
        base = total * 0 - (reached if first == last else 0)
        for i, at in enumerate(starts):
            base[at : starts[i + 1] if i + 1 < len(starts) else None] = total[at - 1]
        upto = total - base
        last, reached = (group[-1].as_py(), field[-1].as_py()), int(upto[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * b.num_rows, pa.int32()), group, field, b.column("value"), b.column("n"), pa.array(upto)],
            names=["task", "group", "field", "value", "n", "upto"],
        )
