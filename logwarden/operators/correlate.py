"""Sliding-window counts and follow-up correlation that hold under any key skew.

Time is cut into cells as wide as the window.  The first rows ("head") and last rows
("tail") of a cell, up to the threshold, decide everything: a row with enough earlier rows
in its own cell has reached the threshold, and one near the start of its cell needs just the
tail of the cell before.  Heads and tails are bounded per cell and cut down on the map side,
so no task ever receives all rows of a busy key or of a busy cell.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logwarden.functions.clock import MICROS, cell
from logwarden.staging import stage

KEYS = ["counter", "key", "cell"]
# Spark cuts groups on the map side up to this many rows (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def heads_and_tails(hits: DataFrame, rows: int) -> DataFrame:
    """First and last ``rows`` rows of every cell; tails are filed under the next cell.

    ``hits``: counter, key, width (micros), us, event_id.
    """
    head = F.struct(
        cell(F.col("us"), F.col("width")).alias("cell"), F.lit(False).alias("tail"),
        F.col("us").alias("o1"), F.col("event_id").alias("o2"),
    )
    tail = F.struct(
        (cell(F.col("us"), F.col("width")) + 1).alias("cell"), F.lit(True).alias("tail"),
        (-F.col("us")).alias("o1"), (-F.col("event_id")).alias("o2"),
    )
    ends = hits.select("counter", "key", "width", F.inline(F.array(head, tail)))
    place = W.partitionBy(*KEYS, "tail").orderBy("o1", "o2")
    sign = F.when(F.col("tail"), -1).otherwise(1)
    return (
        ends.withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= rows)
        .select(*KEYS, "width", "tail", "place",
                (F.col("o1") * sign).alias("us"), (F.col("o2") * sign).alias("event_id"))
    )


def not_reached(hits: DataFrame, limits: dict[str, dict[str, int]]) -> DataFrame:
    """``(event_id, rule_id)`` of the hits that have not reached their rule's count.

    ``limits``: counter -> rule id -> smallest count that fires.  Windows include both ends
    and the row itself; rows of equal time count in event order.
    """
    most = max(n for rules in limits.values() for n in rules.values())
    if most <= 1:
        return hits.select("event_id", F.lit("").alias("rule_id")).filter(F.lit(False))
    ends = heads_and_tails(hits, most - 1)
    order = W.partitionBy(*KEYS).orderBy("us", "event_id")
    needed = sorted({n for rules in limits.values() for n in rules.values() if n > 1})
    looked = ends.withColumns({f"back{n}": F.lag("us", n - 1).over(order) for n in needed})
    start = F.col("us") - F.col("width")
    short = [
        F.when(
            (F.col("counter") == counter) & F.coalesce(F.col(f"back{n}") < start, F.lit(True)),
            F.lit(rule_id),
        )
        for counter, rules in limits.items() for rule_id, n in rules.items() if n > 1
    ]
    return (
        looked.filter(~F.col("tail"))
        .select("event_id", F.explode(F.array_compact(F.array(*short))).alias("rule_id"))
    )


def below_count(hits: DataFrame, limits: dict[str, int], seconds: int) -> DataFrame:
    """``not_reached`` of one counter for counts of any size, by exact trailing counts."""
    counted = trailing_count(hits, "key", F.col("us"), seconds)
    short = [F.when(F.col("recent") < n, F.lit(rule_id)) for rule_id, n in limits.items()]
    return counted.select("event_id", F.explode(F.array_compact(F.array(*short))).alias("rule_id"))


def not_supported(
    followups: DataFrame, hits: DataFrame, at_least: int, seconds: int, hit_seconds: int, pruned: bool
) -> DataFrame:
    """``event_id`` of the follow-ups without ``at_least`` hits in the ``seconds`` before.

    ``followups``: key, us, event_id.  ``hits``: as for ``heads_and_tails``, one counter of
    width ``hit_seconds``.  ``pruned``: hits older than the hit window at the time of the
    last hit are forgotten, so the hits must also lie within one hit window of that last hit.

    Per (key, cell) one bounded row lists the first hits of the cell and the last hits
    before it; follow-ups meet it in an equi-join whose follow-up side may be split freely.
    """
    if seconds < hit_seconds:
        raise ValueError("the look-back may not be shorter than the hit window")
    width = hit_seconds * MICROS
    back = -(-seconds // hit_seconds)
    hit = F.struct("us", "event_id")
    context = (
        heads_and_tails(hits, at_least)
        .select(
            "key", "tail", hit.alias("hit"),
            F.explode(
                F.when(F.col("tail"), F.sequence(F.col("cell"), F.col("cell") + (back - 1)))
                .otherwise(F.array("cell"))
            ).alias("cell"),
        )
        .groupBy("key", "cell")
        .agg(
            F.sort_array(F.collect_list(F.when(~F.col("tail"), F.col("hit")))).alias("own"),
            F.sort_array(F.collect_list(F.when(F.col("tail"), F.col("hit")))).alias("earlier"),
        )
    )
    joined = followups.withColumn("cell", cell(F.col("us"), width)).join(context, ["key", "cell"], "left")
    own = F.filter("own", lambda h: h <= hit)
    last = F.slice(F.reverse(F.concat("earlier", own)), 1, at_least)
    latest, oldest = F.get(last, F.lit(0))["us"], F.get(last, F.lit(at_least - 1))["us"]
    near = oldest >= F.col("us") - seconds * MICROS
    if pruned:
        near = near & (oldest >= latest - width)
    supported = (F.size(own) >= at_least) | ((F.size(last) >= at_least) & near)
    return joined.filter(~F.coalesce(supported, F.lit(False))).select("event_id")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """End marks of a range up to each of its marks, which come in order."""
    seen = 0
    for batch in batches:
        inside = seen + np.cumsum(np.asarray(batch.column("is_end")), dtype=np.int64)
        seen = int(inside[-1]) if len(inside) else seen
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside)], [*batch.schema.names, "inside"])


def trailing_count(
    rows: DataFrame, key: str, ts_us: Column, seconds: int, event_id: str = "event_id"
) -> DataFrame:
    """Exact number of rows of the same key in ``[t - seconds, t]`` up to each row, any skew.

    Every row becomes an end mark at ``t`` and a start mark at ``t - seconds``; its count is
    the number of end marks between the two in the order (key, time).  The marks are cut into
    ranges of that order by sampled bounds, which split a busy key and even a busy instant,
    and counts before a range are carried by one small row per range.  ``rows`` is read twice
    (once for the sample), so it should be a written table.  The marks travel once to their range and
    once to their row; inside a range they are counted as they stream by in order.
    """
    end = F.struct(F.col("_us").alias("at"), F.lit(1).alias("is_end"))
    start = F.struct((F.col("_us") - seconds * MICROS).alias("at"), F.lit(0).alias("is_end"))
    order = ["_key", "at", "is_end", "_id"]
    marks = (
        rows.select(F.col(key).alias("_key"), ts_us.alias("_us"), F.col(event_id).alias("_id"))
        .select("_key", "_id", F.inline(F.array(end, start)))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select("_id", "is_end", F.spark_partition_id().alias("part"))
    )
    # range bounds are sampled: written once before the two uses below, with the counts inside a range
    kind = rows.schema[event_id].dataType.simpleString()
    marks = stage(marks.mapInArrow(_running, f"_id {kind}, is_end int, part int, inside bigint"), "marks")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        marks.groupBy("part").agg(F.sum("is_end").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    ranked = marks.join(F.broadcast(offsets), "part")  # one small row for each shuffle range
    signed = (F.col("inside") + F.col("offset")) * F.when(F.col("is_end") == 1, 1).otherwise(-1)
    return ranked.groupBy(F.col("_id").alias(event_id)).agg(F.sum(signed).alias("recent"))
