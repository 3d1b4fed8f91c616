"""Session settings for tests and single-machine runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, partitions: int | None = None) -> SparkSession:
    """A session on this machine; on a cluster the session comes from outside and nothing here is used."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgertide")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", os.environ.get("LEDGERTIDE_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
