"""Writes that can be repeated without changing the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgertide.operators.dedup import first_written, last_written, new_rows


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_new(incoming: DataFrame, path: str, key: str, order: str, partition_by: str | None = None, same: list[str] | None = None) -> int:
    """Append the rows whose key isn't stored yet (of several the first) and give their number.

    With ``partition_by``, a column that all rows of a key share and that has few values, the table is
    partitioned by it, and only the partitions that ``incoming`` belongs to are read. ``same`` as in
    :func:`~ledgertide.operators.dedup.first_written`.
    """
    before = stored(incoming.sparkSession, path)
    if before is not None and partition_by is not None:
        parts = [r[0] for r in incoming.select(partition_by).distinct().collect()]  # few values
        before = before.where(F.col(partition_by).isin(parts))
    rows = first_written(incoming, key, order, same) if before is None else new_rows(incoming, before, key, order, same)
    rows = rows.persist()
    try:
        count = rows.count()
        if count:
            writer = rows.write.mode("append")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return count
    finally:
        rows.unpersist()


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write ``rows`` over the partitions they belong to; other partitions stay."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replace_together(tables: dict[str, DataFrame], folder: str, by: str) -> None:
    """Write several tables of ``folder`` over the partitions they belong to, all of them or none.

    They are written apart first. Then one file says that they stand, and their partitions are moved to
    their places. A job that dies before that file exists has changed nothing; one that dies later is
    finished by :func:`finish_replacing`, which every writer and reader calls first.
    """
    spark = next(iter(tables.values())).sparkSession
    finish_replacing(spark, folder)
    aside = f"{_ASIDE}{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.repartition(by).write.partitionBy(by).parquet(f"{folder}/{aside}/{name}")
    fs, path = _files(spark, folder)
    with_content = fs.create(path(f"{aside}/{_STANDS}"), True)
    with_content.close()
    _rename(fs, path(f"{aside}/{_STANDS}"), path(_STANDS + aside))
    finish_replacing(spark, folder)


_ASIDE, _STANDS = "_aside-", "_stands-"


def finish_replacing(spark: SparkSession, folder: str) -> None:
    """Move what a job left that died while it replaced partitions, and drop what it hadn't finished."""
    fs, path = _files(spark, folder)
    if not fs.exists(path("")):
        return
    names = [f.getPath().getName() for f in fs.listStatus(path(""))]
    for name in names:
        if name.startswith(_STANDS) and (aside := name.removeprefix(_STANDS)) in names:
            for table in fs.listStatus(path(aside)):
                if not table.isDirectory():
                    continue
                to = table.getPath().getName()
                for part in fs.listStatus(table.getPath()):
                    if part.isDirectory():
                        place = path(f"{to}/{part.getPath().getName()}")
                        fs.delete(place, True)
                        fs.mkdirs(path(to))
                        _rename(fs, part.getPath(), place)
            fs.delete(path(aside), True)
    for name in names:
        if name.startswith((_ASIDE, _STANDS)):
            fs.delete(path(name), True)


def _files(spark: SparkSession, folder: str):
    """The file system of ``folder`` and a function that makes paths in it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    path = lambda name: jvm_path(f"{folder}/{name}" if name else folder)
    return path("").getFileSystem(spark._jsc.hadoopConfiguration()), path


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")


def upserted(stored_rows: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Both tables as one, the last write of each key standing."""
    return last_written(stored_rows.unionByName(incoming), key, order)
