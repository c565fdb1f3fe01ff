"""Log sources: text files, directories of rotated files, syslog records, submitted lines."""

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden.functions import text
from logwarden.functions.clock import utc_now


def _as_logs(lines: DataFrame, source: Column, ts: Column | None) -> DataFrame:
    arrival = utc_now() if ts is None else ts
    return lines.select(
        arrival.alias("ts"), source.alias("source"),
        text.strip(F.make_valid_utf8("value")).alias("raw"),
    )


def spread(lines: DataFrame) -> DataFrame:
    """Input with fewer splits than cores (say one gzip file) over all cores before parsing.

    Input with enough splits, the usual case, goes on unchanged.
    """
    cores = lines.sparkSession.sparkContext.defaultParallelism
    return lines.repartition(cores) if lines.rdd.getNumPartitions() < cores else lines


def number_rows(lines: DataFrame) -> DataFrame:
    """Add a unique ``event_id`` that rises within every input split (with gaps, no shuffle)."""
    return lines.select(F.monotonically_increasing_id().alias("event_id"), "*")


def write_lines(lines: DataFrame, path: str) -> DataFrame:
    """Write the lines once with their arrival time, input split and place in it; gives the table.

    All later steps read this table, so times and order stay as they are however often it is read.
    """
    split, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = [c for c in lines.columns if c != "event_id"]
    lines.select(split.alias("_split"), place.alias("_place"), *kept).write.parquet(path)
    return lines.sparkSession.read.parquet(path)


def numbered(written: DataFrame, first_id: int = 0) -> DataFrame:
    """Lines of ``write_lines`` with a dense ``event_id`` from ``first_id``, rising within an input
    split and from split to split; the same each time for the same written lines.

    Lines are dealt out by their id, not by split: a few splits may hold most of them (one gzip file), and
    what follows, parsing above all, would be the work of as few tasks."""
    kept = [c for c in written.columns if c not in ("_split", "_place")]
    sizes = written.groupBy("_split").agg((F.max("_place") + 1).alias("n"))  # one row for each input split
    before = sizes.select("_split", (F.sum("n").over(W.orderBy("_split")) - F.col("n")).alias("_before"))
    lines = written.join(F.broadcast(before), "_split").select((F.col("_before") + F.col("_place") + first_id).alias("event_id"), *kept)
    return lines.repartition("event_id")


def read_lines(spark: SparkSession, path: str, source: str, ts: Column | None = None) -> DataFrame:
    """Lines of text files; invalid UTF-8 becomes U+FFFD, time is the arrival time unless ``ts``
    takes it from ``value`` or ``_metadata``."""
    return _as_logs(spark.read.text(path), F.lit(source), ts)


def stream_lines(
    spark: SparkSession, path: str, source: str, ts: Column | None = None, max_bytes: int = 2 * 1024**3
) -> DataFrame:
    """Lines of files as they land in a directory (rotated, never appended).

    ``max_bytes`` bounds a micro-batch, and with it what one busy key can bring to one task.
    """
    lines = spark.readStream.option("maxBytesPerTrigger", max_bytes).text(path)
    return _as_logs(lines, F.lit(source), ts)


def watch_list(entries=fixed.WATCHED_LOGS) -> list[tuple[str, str]]:
    """Path and source name of each entry: a path, a (path, name) pair or a mapping."""
    watched = []
    for entry in entries:
        if isinstance(entry, str):
            path, name = entry, None
        elif isinstance(entry, dict):
            path, name = entry.get("path", ""), entry.get("name")
        else:
            path, name = entry
        if path:
            watched.append((path, os.path.basename(path) if name is None else name))
    return watched


def read_watched(spark: SparkSession, entries, stream: bool = False, ts: Column | None = None) -> DataFrame:
    """All watched logs as one table of ``ts, source, raw``.  As a stream it goes to
    ``streaming.landing``, which gives its lines ids."""
    read = stream_lines if stream else read_lines
    tables = [read(spark, path, name, ts) for path, name in watch_list(entries)]
    if not tables:
        raise ValueError("nothing to watch")
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return merged


def syslog_records(records: DataFrame) -> DataFrame:
    """Landed syslog datagrams ``sender_ip, line, ...``: the source names the sender."""
    kept = [c for c in records.columns if c not in ("sender_ip", "line")]
    return records.select(
        *kept, F.concat(F.lit("syslog:"), F.col("sender_ip")).alias("source"),
        text.strip(F.make_valid_utf8(F.col("line"))).alias("raw"),
    )


def eve_alerts(lines: DataFrame) -> DataFrame:
    """IDS JSON lines that are alerts."""
    return lines.filter(F.get_json_object("raw", "$.event_type") == "alert")


def submitted(records: DataFrame) -> DataFrame:
    """Directly submitted records: empty lines are refused, the source defaults to ``api``.

    They skip cleaning and the admission limit.
    """
    return records.filter(F.coalesce("raw", F.lit("")) != "").withColumn(
        "source", F.coalesce("source", F.lit("api"))
    )
