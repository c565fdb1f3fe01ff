"""Text streams to tables: lines get ids that a replay does not change, late rows become data.

1. ``land`` writes each micro-batch once, claims its ids in the run ledger by the batch's number,
   sets rows aside that are later than the allowed delay, and gives the numbered lines their
   final folder name. A replayed batch finds its claim, so lines, times and ids stay as they were.
2. ``detect_into`` reads these folders as a stream and stores events and alerts as a run.

Time: a row is late if it lies more than ``delay`` before the newest row of all micro-batches
before its own. This border is part of the claims, so it does not depend on when Spark moves a
watermark, and it holds over restarts.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logwarden import schema
from logwarden.functions.clock import MICROS, micros
from logwarden.operators.clean import strip_lines, tidy_lines
from logwarden.operators.detect import REFERENCE, describe, flag_events
from logwarden.operators.parse import parse
from logwarden.operators.rules import BUILT_IN
from logwarden.plans.jobs import located
from logwarden.sources import store
from logwarden.sources.logs import numbered, write_lines
from logwarden.sources.runs import RunTables
from logwarden.staging import remove, scratch, stage
from logwarden.streaming.counted import CountedAdmission, CountedRules

Batch = Callable[[DataFrame, int], None]
LATE = "behind the newest row by more than the delay"


def land(tables: RunTables, name: str = "lines", delay: int = 10) -> Batch:
    """``foreachBatch`` function for lines (ts, source, raw, ...) of the stream ``name``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        key = f"{name}/{batch_id}"
        claim = tables.find(key)
        if claim is None:
            before = tables.find(f"{name}/{batch_id - 1}")
            border = None if before is None or before.newest is None else before.newest - delay * MICROS
            late = F.lit(False) if border is None else F.coalesce(micros(F.col("ts")) < border, F.lit(False))
            folder = tables.new_folder("lines")
            written = write_lines(batch.withColumn("_late", late), folder)
            rows, behind, newest = written.agg(F.count("*"), F.count_if("_late"), micros(F.max("ts"))).first()
            newest = max([t for t in (newest, before and before.newest) if t is not None], default=None)
            claim = tables.claim(key, rows, late=behind, newest=newest, lines=folder)
        if tables.is_committed(claim):
            return
        lines = numbered(tables.spark.read.parquet(claim.lines), claim.first_id)
        for label, chosen in (("late", lines.filter("_late")), ("landed", lines.filter("not _late"))):
            if label == "landed" or claim.late:
                draft = tables.new_folder(label)
                chosen.drop("_late").write.parquet(draft)
                tables.publish(draft, tables.path(label, f"run={claim.number}"))
        tables.commit(claim)
        remove(tables.spark, claim.lines)
    return write


def landed(tables: RunTables) -> DataFrame:
    """The numbered lines as a stream, whole micro-batches of ``land`` in their order."""
    files, folder = store.file_at(tables.spark, tables.path("landed"))
    files.mkdirs(folder)
    return tables.spark.readStream.schema(schema.RAW_LOGS).parquet(tables.path("landed", "run=*")).select(*schema.RAW_LOGS.names)


def late_lines(tables: RunTables) -> DataFrame:
    """Lines that came too late, with the run that brought them and the reason."""
    layout = StructType([*schema.RAW_LOGS.fields, StructField("run", LongType())])
    if not store.exists(tables.spark, tables.path("late")):
        return tables.spark.createDataFrame([], layout).withColumn("reason", F.lit(LATE))
    return tables.spark.read.schema(layout).parquet(tables.path("late")).withColumn("reason", F.lit(LATE))


def landing_metrics(tables: RunTables, name: str = "lines") -> DataFrame:
    """Rows, late rows and newest time (micros) of each micro-batch; kept with the ledger."""
    mine = tables.claims().filter(F.startswith("key", F.lit(f"{name}/")))
    batch = F.substring_index("key", "/", -1).cast("long").alias("batch")
    return mine.select(batch, F.col("number").alias("run"), "rows", "late", "newest")


def detect_into(
    tables: RunTables, ranges: DataFrame | None = None, rules=BUILT_IN, mode: str = REFERENCE, delay: int = 10, name: str = "detect",
    limited: bool = False,
) -> Batch:
    """``foreachBatch`` function for numbered lines: events and alerts, committed as one run.
    ``limited`` applies the admission limit."""
    counted = CountedRules(tables.path("_state", name), rules, mode, delay)
    admission = CountedAdmission(tables.path("_state", f"{name}-admission"), delay=delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        claim = tables.claim(f"{name}/{batch_id}")
        if tables.is_committed(claim):
            return
        with scratch(tables.spark):
            lines = strip_lines(batch)
            events = stage(parse(tidy_lines(admission.admit(lines, batch_id) if limited else lines)), "parsed")
            # what fired is written once as it is; names and texts of the rules are added where the alerts are stored
            fired = stage(counted.fire(events, batch_id), "fired")
            alerts = located(describe(fired, rules), ranges)
            tables.write(claim, flag_events(events, fired), alerts)
        tables.commit(claim)
    return write
