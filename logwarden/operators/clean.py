"""Raw line cleaning and the per-source admission limit."""

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden.functions import text
from logwarden.functions.clock import MICROS, cell, micros
from logwarden.staging import sized, stage


def strip_lines(logs: DataFrame) -> DataFrame:
    """Strip both ends and drop lines that are then empty."""
    return logs.withColumn("raw", text.strip(F.col("raw"))).filter(F.col("raw") != "")


def tidy_lines(logs: DataFrame) -> DataFrame:
    """Cut to the longest allowed line, then remove colour codes."""
    return logs.withColumn("raw", text.drop_ansi(text.truncate(F.col("raw"))))


def clean(logs: DataFrame, limited: bool = False) -> DataFrame:
    """Strip, drop empty, admit, cut, remove colours: in this order.

    ``limited`` needs landed lines: the limit reads them several times, and their times decide.
    """
    lines = strip_lines(logs)
    return tidy_lines(rate_limit(lines) if limited else lines)


class Walk:
    """Admission of one source, instant by instant in time order, with the admitted rows of the last
    window as its only memory.  Where the window is full it goes on at the instant that frees it, so the
    work grows with the admitted rows and not with the refused ones."""

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width
        self.held: deque[tuple[int, int]] = deque()
        self.inside = 0

    def _hold(self, us: int, rows: int) -> None:
        self.held.append((us, rows))
        self.inside += rows

    def take(self, us: np.ndarray, rows: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Rows admitted per instant; ``given`` >= 0 marks instants decided before."""
        admitted = np.where(given >= 0, given, 0)
        decided = np.flatnonzero(given >= 0)
        now = 0
        while now < len(us):
            at = int(us[now])
            while self.held and self.held[0][0] < at - self.width:
                self.inside -= self.held.popleft()[1]
            if given[now] >= 0:
                self._hold(at, int(given[now]))
            elif self.inside < self.limit:
                admitted[now] = min(int(rows[now]), self.limit - self.inside)
                self._hold(at, int(admitted[now]))
            else:
                free = int(np.searchsorted(us, self.held[0][0] + self.width, "right"))
                known = np.searchsorted(decided, now, "right")
                now = min(max(free, now + 1), int(decided[known]) if known < len(decided) else len(us))
                continue
            now += 1
        return admitted


def _walked(batches: Iterator[pa.RecordBatch], limit: int, width: int) -> Iterator[pa.RecordBatch]:
    """Ticks sorted by (source, run, us) with the rows admitted in each; only those with some are passed on."""
    key, walk = None, Walk(limit, width)
    for batch in batches:
        source, run = batch.column("source").to_pylist(), np.asarray(batch.column("run"))
        us, rows, given = (np.asarray(batch.column(c)) for c in ("us", "rows", "given"))
        new = [n for n in range(len(run)) if n == 0 or run[n] != run[n - 1] or source[n] != source[n - 1]]
        admitted = np.zeros(len(run), np.int64)
        for first, last in zip(new, [*new[1:], len(run)]):
            if (source[first], run[first]) != key:
                key, walk = (source[first], run[first]), Walk(limit, width)
            admitted[first:last] = walk.take(us[first:last], rows[first:last], given[first:last])
        kept = np.flatnonzero((admitted > 0) & (given < 0))
        chosen = batch.select(["source", "us", "rows"]).take(pa.array(kept))
        yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(admitted[kept])], ["source", "us", "rows", "admitted"])


def rate_limit(
    logs: DataFrame,
    limit: int = fixed.RATE_LIMIT_ROWS,
    seconds: int = fixed.RATE_LIMIT_SECONDS,
    given: DataFrame | None = None,
) -> DataFrame:
    """Rows admitted when each source may have ``limit`` admitted rows in ``[t-seconds, t]``.

    Each admission depends on earlier admissions, so a source is sequential, but only where
    the limit can be reached at all:

    1. Per (source, cell of ``seconds``) rows are counted.  Where a cell and the one before
       hold at most ``limit`` rows, everything is admitted, and nothing is shuffled for it.
    2. The other cells are reduced to one row per instant ("tick") with its row count.
    3. Runs of neighbouring busy cells are walked through in time order, all in one job: a task streams
       the ticks of a run by and remembers the admitted ones of the last window.  A source that is busy
       without pause is one run.
    4. Admitted ticks select their rows: all of them, or the first ones in event order.

    ``given`` (source, us, admitted): instants that were decided before, say in earlier micro-batches.
    """
    width = seconds * MICROS
    timed = logs.withColumn("us", micros(F.col("ts"))).withColumn("cell", cell(F.col("us"), width))
    counts = timed.groupBy("source", "cell").agg(F.count("*").alias("count"))
    if given is not None:
        known = given.withColumn("cell", cell(F.col("us"), width))
        counts = counts.unionByName(known.groupBy("source", "cell").agg(F.sum("admitted").alias("count"))).groupBy(
            "source", "cell").agg(F.sum("count").alias("count"))
    counts = stage(counts, "cells")
    before = counts.select("source", (F.col("cell") + 1).alias("cell"), F.col("count").alias("before"))
    total = F.coalesce("count", F.lit(0)) + F.coalesce("before", F.lit(0))
    busy = counts.join(before, ["source", "cell"], "left").filter(total > limit).select("source", "cell")
    # Busy cells plus the quiet cell before each run, which sets its starting point.
    lead = busy.select("source", (F.col("cell") - 1).alias("cell")).join(counts, ["source", "cell"], "left_semi")
    in_order = W.partitionBy("source").orderBy("cell")
    fresh = F.coalesce((F.col("cell") - F.lag("cell").over(in_order) > 1).cast("bigint"), F.lit(1))
    needed = busy.unionByName(lead).distinct().withColumn("fresh", fresh).select("source", "cell", F.sum("fresh").over(in_order).alias("run"))
    needed = stage(needed, "needed")
    if needed.isEmpty():
        return logs

    needed = sized(needed)
    ticks = timed.join(needed, ["source", "cell"]).groupBy("source", "run", "us").agg(F.count("*").alias("rows")).withColumn(
        "given", F.lit(-1).cast("bigint"))
    if given is not None:
        ticks = ticks.unionByName(known.join(needed, ["source", "cell"]).select("source", "run", "us", F.col("admitted").alias("rows"), F.col("admitted").alias("given")))
    ordered = ticks.repartition("source", "run").sortWithinPartitions("source", "run", "us", F.desc("given"))
    decided = sized(stage(ordered.mapInArrow(lambda batches: _walked(batches, limit, width), "source string, us bigint, rows bigint, admitted bigint"), "decided"))
    quiet = timed.join(needed, ["source", "cell"], "left_anti")
    walked = timed.join(needed, ["source", "cell"], "left_semi").join(decided, ["source", "us"])
    first = W.partitionBy("source", "us").orderBy("event_id")
    whole = walked.filter(F.col("admitted") == F.col("rows"))
    partly = (
        walked.filter(F.col("admitted") < F.col("rows"))
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= limit)
        .filter(F.col("place") <= F.col("admitted"))
    )
    columns = logs.columns
    return quiet.select(columns).unionByName(whole.select(columns)).unionByName(partly.select(columns))
