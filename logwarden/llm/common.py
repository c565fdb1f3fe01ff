"""Staging and row identity shared by the operators of this package."""

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import staging

LOWEST = -(1 << 63)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder, go on from the written table, free what made it.

    Shuffle files go when the driver collects the objects of the plan that wrote them; asking
    for it after each written step keeps the disk of a job at its dearest step.
    """
    spark = df.sparkSession
    out = staging.stage(df, label)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Ask the executors for a full collection, so that heap which one job grew is given back before the
    next one's Python workers need the memory. A few tasks reach each executor that has a free core."""
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def few(rows: DataFrame, many: int, *key: str) -> list:
    """Rows chosen by the hash of ``key``: all of a table of at most ``many`` rows, else about half
    of ``many`` and never more. An ordered limit would send the driver ``many`` rows of every task.
    Where all rows are alike and their hash is not chosen, the first ones serve."""
    n = rows.count()
    chosen = rows.filter(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) < (1 << 39) * many // n) if n > many else rows
    return chosen.limit(many).collect() or rows.limit(many).collect()


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def rank_of() -> Column:
    """Rank of a document's id; null is lowest."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))


def text_key(salt: int) -> Column:
    """64 bits of a text, other ones for each salt."""
    return F.xxhash64(F.lit(salt), text_of())


def salt_for(docs: DataFrame) -> int:
    """A salt with which (rank, text key) names one text only: rows of one id, and all rows without
    id, may have many texts. Two more keys show whether texts differ."""
    salt = 0
    while True:
        named = docs.select(rank_of().alias("doc"), text_key(salt).alias("key"), text_key(-1 - salt).alias("a"), F.xxhash64(text_of()).alias("b"))
        clash = named.groupBy("doc", "key").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "ab" for f in (F.min, F.max)]).filter(
            "min_a <> max_a OR min_b <> max_b")
        if clash.isEmpty():
            return salt
        salt += 1


def keyed(docs: DataFrame, salt: int) -> DataFrame:
    """doc_id, its rank ``doc``, the text, and its key, with the salt of ``salt_for``.

    (doc, row_key) names a text: repeated rows share it, rows of one id with other texts do not.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), rank_of().alias("doc"), text_key(salt).alias("row_key"), text_of().alias("text"))
