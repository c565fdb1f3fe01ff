"""Whole jobs: from raw lines to the two tables, the outbox and the answer to a submission."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions import severity
from logwarden.operators.clean import clean
from logwarden.operators.detect import REFERENCE, detect, flag_events
from logwarden.operators.enrich import add_geo, unlocated
from logwarden.operators.parse import parse
from logwarden.operators.rules import BUILT_IN
from logwarden.sources.logs import numbered, submitted, write_lines
from logwarden.sources.runs import RunTables
from logwarden.staging import remove, scratch, stage


def located(alerts: DataFrame, ranges: DataFrame | None) -> DataFrame:
    """Alerts with location; they are read twice for it, so they are written once first."""
    return unlocated(alerts) if ranges is None else add_geo(stage(alerts, "unlocated"), ranges)


def run_batch(
    logs: DataFrame, tables: RunTables, key: str | None = None, ranges: DataFrame | None = None,
    rules=BUILT_IN, mode: str = REFERENCE, limited: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Clean, parse, detect and store as one run; returns the committed events and alerts.

    The lines are written first, so their arrival time and order are fixed before anything reads
    them twice; the claim of the run then fixes their ids.  With the same ``key`` (say the day or the
    list of files) a broken run is taken up from its written lines and a committed one is left as it is;
    without a key every call is a run of its own.  Parsed events are written once; detection and flagging
    read columns.  ``limited`` applies the admission limit, which belongs to lines that arrive over
    time: the lines of a file read at once all have one arrival time.
    """
    key = key or uuid.uuid4().hex
    claim = tables.find(key)
    if claim is None:
        folder = tables.new_folder("lines")
        claim = tables.claim(key, write_lines(logs, folder).count(), lines=folder)
    if not tables.is_committed(claim):
        with scratch(tables.spark):
            lines = numbered(tables.spark.read.parquet(claim.lines), claim.first_id)
            events = stage(parse(clean(lines, limited)), "parsed")
            alerts = stage(located(detect(events, rules, mode), ranges), "alerts")
            tables.write(claim, flag_events(events, alerts), alerts)
        tables.commit(claim)
        remove(tables.spark, claim.lines)
    return tables.events(), tables.alerts()


def submit(records: DataFrame, rules=BUILT_IN, mode: str = REFERENCE) -> DataFrame:
    """``event_id`` and number of alerts of each accepted submission."""
    events = parse(submitted(records))
    counts = detect(events, rules, mode).groupBy("event_id").agg(F.count("*").alias("n"))
    return events.select("event_id").join(counts, "event_id", "left").select(
        "event_id", F.coalesce("n", F.lit(0)).alias("alerts")
    )


def outbox(alerts: DataFrame, lowest: str = "HIGH", brand: str = "Security log analytics") -> DataFrame:
    """Messages of the alerts severe enough to be sent."""
    return alerts.filter(severity.at_least(F.coalesce("severity", F.lit("LOW")), lowest)).select(
        "alert_id", severity.notification(brand).alias("payload")
    )


def append_outbox(alerts: DataFrame, path: str, lowest: str = "HIGH", brand: str = "Security log analytics") -> None:
    outbox(alerts, lowest, brand).write.mode("append").parquet(path)
