"""Tables written between two steps, and size checks before a broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a session that runs in one local JVM gets a temporary folder of its own; on a cluster
    without the setting this raises, since a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="ledgertide-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but columnar, so later steps prune columns. A lost executor
    costs nothing: the files outlive it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgertide/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete every table ``written`` has left in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/ledgertide")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else ``df`` as it is.

    The count stops at ``max_rows + 1`` rows, so a large ``df`` isn't read through; without the mark
    the join is planned as a shuffle join, which AQE may still split on skew.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
