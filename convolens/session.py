"""Session settings for local tests and clusters."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_KEPT: list[DataFrame] = []
_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; a cluster passes its own settings to spark-submit instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("convolens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Rows can be long texts: smaller batches keep Python workers small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def keep(df: DataFrame) -> DataFrame:
    """Hold a narrow table that several steps read, so the texts behind it are read once.

    Partitions that do not fit go to disk, and those of a lost executor are computed again.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(held)
    return held


def release() -> None:
    """Let go of everything that was kept."""
    while _KEPT:
        _KEPT.pop().unpersist()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they run; once per application.

    A job submitted with the package among its --py-files does not need it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="convolens-"), name), "zip", root, name)
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
