"""A keyed table that a stream keeps up to date: every micro-batch writes the keys it changed.

Counts of an hour are right as soon as a micro-batch has ended, and change when a later one brings
more rows of that hour; no watermark has to pass and nothing but changed keys is written. Each
micro-batch is a version: a folder of its own, overwritten when it is replayed, made from the versions
before it. Every WHOLE-th version holds all keys, so a reader needs at most that many.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.sources.store import file_at

WHOLE = 100


class KeyedCounts:
    """``n`` rows for each value of ``key`` over all micro-batches so far."""

    def __init__(self, spark: SparkSession, path: str, key: str, whole: int = WHOLE):
        self.spark, self.path, self.key, self.every = spark, path, key, whole
        self.schema = f"{key} string, n long, batch long"

    def at(self, batch_id: int) -> DataFrame:
        """(key, n) after a micro-batch."""
        files, folder = file_at(self.spark, self.path)
        if batch_id < 0 or not files.exists(folder):
            return self.spark.createDataFrame([], f"{self.key} string, n long")
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        known = rows.filter(F.col("batch").between(batch_id // self.every * self.every, batch_id))
        return known.groupBy(self.key).agg(F.max_by("n", "batch").alias("n"))

    def now(self) -> DataFrame:
        """(key, n) after the last micro-batch."""
        files, folder = file_at(self.spark, self.path)
        found = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return self.at(max((int(name[6:]) for name in found if name.startswith("batch=")), default=-1))

    def sink(self, key: Column, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
        """``foreachBatch`` function that counts rows by ``key``."""
        def write(batch: DataFrame, batch_id: int) -> None:
            fresh = change(batch).groupBy(key.alias(self.key)).agg(F.count("*").alias("n"))
            before = self.at(batch_id - 1)
            if batch_id % self.every:
                before = before.join(fresh.select(self.key), self.key, "left_semi")
            both = before.unionByName(fresh).groupBy(self.key).agg(F.sum("n").alias("n"))
            both.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return write
