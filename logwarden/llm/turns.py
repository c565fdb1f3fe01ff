"""Rows of conversations in order, with a way for conversations of any size.

A conversation's weight is summed first (on the map side). Those up to a limit go whole to one
task. The few beyond it are laid out by sampled ranges of (conversation, order), written once with
their place in the range, and their running sums are carried from range to range by one small row
for each range that a conversation touches; so a conversation of any share is cut into blocks.

Order within a conversation: turn (null first); rows of one turn by the SHA-256 of role and text.
"""

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import stage
from logwarden.staging import sized

ORDER = ("turn", "digest")


def digest(role: Column, text: Column) -> Column:
    """Names role and text together."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def name(conv_id: Column) -> Column:
    """Conversation as a key without null."""
    return F.concat(F.lit("c"), F.coalesce(conv_id.cast("long").cast("string"), F.lit("")))


@dataclasses.dataclass(frozen=True)
class Split:
    """``short``: rows of conversations up to the limit. ``long``: rows of the others, or None where
    there are none; ``totals``: conv and total weight of these."""

    short: DataFrame
    long: DataFrame | None
    totals: DataFrame


def split(rows: DataFrame, weight: Column, limit: int) -> Split:
    """Rows (conv, ...) by the total weight of their conversation."""
    totals = stage(rows.groupBy("conv").agg(F.sum(weight).alias("total")).filter(F.col("total") > limit), "totals")
    if totals.isEmpty():
        return Split(rows, None, totals)
    heavy = sized(totals.select("conv"))
    return Split(rows.join(heavy, "conv", "left_anti"), rows.join(heavy, "conv", "left_semi"), totals)


def laid_out(rows: DataFrame, weight: Column) -> DataFrame:
    """The rows, written in order, with ``place`` (rows of the conversation before) and ``at``
    (their weight)."""
    ordered = rows.withColumn("weight", weight).repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = stage(ordered.withColumn("part", F.spark_partition_id()).withColumn("index", index), "laid")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = written.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).select(
        "conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("weight_before"))
    inside = Window.partitionBy("part", "conv").orderBy("index")
    running = (F.sum("weight").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")).alias("within")
    return written.select("*", F.row_number().over(inside).alias("number"), running).join(
        sized(stage(carried, "carried")), ["conv", "part"]).select(
            *rows.columns, "weight", (F.col("number") - 1 + F.col("rows_before")).alias("place"),
            (F.col("within") + F.col("weight_before")).alias("at"))
