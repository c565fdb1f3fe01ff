"""Counting rules and the admission limit over micro-batches, with the batch operators and a carried
table as state.

A micro-batch's matches are correlated together with the matches carried from earlier ones by the
same joins and cut-down windows as in batch, so neither a hot key nor a hot minute gathers in one
task, and no row leaves the JVM. The carried table holds, for each rule and key, every match within the
allowed delay of the newest one, and of the older ones that a window can still reach the last as many
as a threshold looks back. It is written for each micro-batch under its number; a replayed batch
starts from the table of the batch before and overwrites its own.

The admission limit carries the admitted instants of the delay and one window.

A row sees the rows that came before it in time and arrival and lie in its window. Rows later than the
delay are to be set aside before (``landing.land``).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden.functions.clock import MICROS, at_micros, micros
from logwarden.operators.clean import rate_limit
from logwarden.operators.detect import REFERENCE, Plan
from logwarden.operators.rules import BUILT_IN, Rule
from logwarden.sources.store import file_at
from logwarden.staging import stage

CARRIED = "event_id long, ts timestamp_ntz, source_ip string, geo_ip string, rule_id string, key string"
INSTANTS = "source string, us long, admitted long"


class Carried:
    """A table for each micro-batch below ``path``; the last few are kept for replays."""

    def __init__(self, path: str, layout: str):
        self.path, self.layout = path, layout

    def after(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        folder = f"{self.path}/batch={batch_id}"
        files, target = file_at(spark, folder)
        return spark.read.schema(self.layout).parquet(folder) if files.exists(target) else None

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        files, old = file_at(rows.sparkSession, f"{self.path}/batch={batch_id - 3}")
        files.delete(old, True)


class CountedAdmission:
    """The admission limit of each source from micro-batch to micro-batch; ``path`` holds the state."""

    def __init__(self, path: str, limit: int = fixed.RATE_LIMIT_ROWS, seconds: int = fixed.RATE_LIMIT_SECONDS, delay: int = 10):
        self.state, self.limit, self.seconds, self.delay = Carried(path, INSTANTS), limit, seconds, delay

    def admit(self, logs: DataFrame, batch_id: int) -> DataFrame:
        """The rows of a micro-batch that are admitted."""
        spark = logs.sparkSession
        earlier = self.state.after(spark, batch_id - 1)
        kept = stage(rate_limit(logs, self.limit, self.seconds, earlier), "admitted")
        us = micros(F.col("ts"))
        times = kept.agg(F.max(us).alias("us")) if earlier is None else kept.select(us.alias("us")).unionByName(earlier.select("us")).agg(F.max("us"))
        newest = times.first()[0]
        instants = kept.select("source", us.alias("us"), F.lit(1).cast("bigint").alias("admitted"))
        if earlier is not None:
            instants = instants.unionByName(earlier)
        border = 0 if newest is None else newest - (self.delay + self.seconds) * MICROS
        self.state.write(instants.filter(F.col("us") >= border).groupBy("source", "us").agg(F.sum("admitted").alias("admitted")), batch_id)
        return kept


class CountedRules:
    """Rules whose counts go on from micro-batch to micro-batch; ``path`` holds the state."""

    def __init__(self, path: str, rules: tuple[Rule, ...] = BUILT_IN, mode: str = REFERENCE, delay: int = 10):
        self.state, self.mode, self.delay, self.rules = Carried(path, CARRIED), mode, delay, rules

    def fire(self, events: DataFrame, batch_id: int) -> DataFrame:
        """What fires in this micro-batch, as ``operators.detect.fire`` gives it."""
        spark, plan = events.sparkSession, Plan(self.rules)
        matches = stage(plan.match(events), "matches")
        earlier = self.state.after(spark, batch_id - 1)
        if plan.counting_tags:
            self._carry(matches if earlier is None else matches.unionByName(earlier), plan, batch_id)
        return plan.fire(matches, self.mode, earlier)

    def _carry(self, known: DataFrame, plan: Plan, batch_id: int) -> None:
        counting = known.filter(F.col("rule_id").isin(plan.counting_tags))
        newest = counting.agg(micros(F.max("ts"))).first()[0]
        rows, seconds = plan.back
        if newest is None:
            kept = counting
        else:
            border = newest - self.delay * MICROS
            # rows to come lie after the border, and so do the windows' ends
            older = counting.filter((F.col("ts") < at_micros(border)) & (F.col("ts") >= at_micros(border - 2 * seconds * MICROS)))
            place = F.row_number().over(W.partitionBy("rule_id", "key").orderBy(F.desc("ts"), F.desc("event_id")))
            last = older.withColumn("_place", place).filter(F.col("_place") <= rows).drop("_place")
            kept = counting.filter(F.col("ts") >= at_micros(border)).unionByName(last)
        self.state.write(kept, batch_id)
