"""Keeping stored lifecycles, effects and snapshots up to date with arriving fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.operators import positions
from ledgertide.operators.dedup import first_written
from ledgertide.operators.storage import written
from ledgertide.sources.sinks import append_new, finish_replacing, replace_together, stored

#: The derived tables are partitioned by a hash of wallet and coin into so many parts, the unit of recompiling.
BUCKETS = 256


def bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("user", "coin"), F.lit(buckets)).cast("int")


def compile_tables(fills: DataFrame, folder: str, only: list[int] | None = None, buckets: int = BUCKETS) -> None:
    """Derive lifecycles, effects and snapshots of ``fills`` and write them over the buckets in ``only``.

    Always from the whole history of a wallet and coin: a position never starts from empty in the middle.
    Written buckets replace the stored ones as a whole and in all tables at once, so running it again
    changes nothing and no reader of :func:`compiled_table` sees one table without the others. With them
    goes ``compiled``: per bucket the number of fills, the last of them and a version that counts up.
    """
    spark = fills.sparkSession
    rows = fills if "bucket" in fills.columns else fills.withColumn("bucket", bucket(buckets))
    rows = rows if only is None else rows.where(F.col("bucket").isin(only))
    first = first_written(rows.drop("bucket"), "fill_key", "id", ["user", "coin", "side"])
    moves = written(positions.transitions(first), "moves")
    derived = {"lifecycles": positions.lifecycles(moves), "effects": positions.effects(moves), "snapshots": positions.snapshots(moves)}
    tables = {name: table.withColumn("bucket", bucket(buckets)) for name, table in derived.items()}
    replace_together({**tables, "compiled": _versions(rows, stored(spark, f"{folder}/compiled"))}, folder, "bucket")


def compiled_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A derived table as of the last compile that stands, None if there was none."""
    finish_replacing(spark, folder)
    return stored(spark, f"{folder}/{name}")


def _sizes(fills: DataFrame) -> DataFrame:
    return fills.groupBy("bucket").agg(F.count(F.lit(1)).alias("fills"))


def _versions(fills: DataFrame, before: DataFrame | None) -> DataFrame:
    """Per bucket how many fills it is compiled from, the last of them, and the version."""
    last = F.max_by("fill_key", F.struct("time_ms", "fill_key")).alias("until_key")
    now = fills.groupBy("bucket").agg(F.count(F.lit(1)).alias("fills"), F.max("time_ms").alias("until_ms"), last)
    if before is None:
        return now.withColumn("version", F.lit(1).cast("long"))
    known = before.groupBy("bucket").agg(F.max("version").alias("version"))  # read and written in one job, as it is set apart first
    return now.join(known, "bucket", "left").withColumn("version", F.coalesce("version", F.lit(0)) + 1)


def _behind(fills: DataFrame, compiled: DataFrame | None) -> list[int]:
    """The buckets that were last compiled from another number of fills than are stored, or never."""
    now = _sizes(fills)
    if compiled is not None:
        now = now.join(compiled.select("bucket", "fills"), ["bucket", "fills"], "left_anti")
    return [r.bucket for r in now.collect()]  # at most `buckets`


def ingest(incoming: DataFrame, folder: str, buckets: int = BUCKETS) -> int:
    """Store the fills that are new and recompile the buckets that have fills not compiled yet; gives the number of new fills.

    Fills may overlap what is stored and may be older than it: a look back costs nothing but the reading.
    Stored fills are partitioned by bucket, so looking for what is new reads the buckets of ``incoming``,
    compiling those that are behind, and finding these the file footers alone. Stored fills are only ever
    added to, so a bucket whose number of fills isn't the one it was compiled from is behind. That also finds fills
    appended by a job that died before it had compiled them, whatever ``incoming`` holds.
    """
    spark, path = incoming.sparkSession, f"{folder}/fills"
    new = append_new(incoming.withColumn("bucket", bucket(buckets)), path, "fill_key", "id", "bucket", ["user", "coin", "side", "bucket"])
    fills = stored(spark, path)
    behind = _behind(fills, compiled_table(spark, folder, "compiled")) if fills is not None else []
    if behind:
        compile_tables(fills, folder, behind, buckets)
    return new
