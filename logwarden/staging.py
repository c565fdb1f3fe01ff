"""Written intermediate tables: cut lineage, survive lost executors, read back column-wise."""

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side up to this many rows of a few narrow columns (tens of megabytes) is broadcast;
# a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def work_folder(spark: SparkSession) -> str:
    """Shared folder of the cluster (``spark.checkpoint.dir``), own folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="logwarden-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end, also after a failure: for jobs that
    write their results, so that a stream that runs for long leaves nothing behind."""
    outer, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        made, _scopes.paths = _scopes.paths, outer
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, label: str) -> str:
    path = os.path.join(work_folder(spark), f"{label}-{uuid.uuid4().hex}")
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged table for broadcast if its counted size allows it."""
    return F.broadcast(df) if df.count() <= max_rows else df
