import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from logwarden import schema, staging
from logwarden.functions.clock import hour_label
from logwarden.operators.clean import rate_limit
from logwarden.operators.detect import detect
from logwarden.operators.parse import parse
from logwarden.plans.reports import events_by_hour
from logwarden.sources import logs
from logwarden.sources.logs import stream_lines
from logwarden.sources.runs import RunTables
from logwarden.streaming import jobs, landing
from logwarden.streaming.counted import CountedAdmission, CountedRules
from logwarden.streaming.upserts import KeyedCounts
from test_correlate import START, random_rows, table
from verification import registry


@pytest.fixture
def feed(spark, tmp_path):
    """Write the rows as several files in time order and stream them one file per micro-batch."""
    def make(logs, files=4):
        rows = sorted(logs.collect(), key=lambda r: r.ts)
        size = -(-len(rows) // files)
        for n in range(files):
            part = spark.createDataFrame(rows[n * size:(n + 1) * size], schema.RAW_LOGS).coalesce(1)
            part.write.parquet(str(tmp_path / f"part{n}"))
        # file streams take the oldest file first
        return spark.readStream.schema(schema.RAW_LOGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
    return make


def run(stream, tmp_path, change=None, name="out"):
    query = jobs.start(stream, jobs.batch_folder(str(tmp_path / name), change), str(tmp_path / f"{name}-state"), available_now=True)
    query.awaitTermination(300)
    assert query.exception() is None
    return stream.sparkSession.read.parquet(str(tmp_path / name)), query


@pytest.mark.parametrize("mode", ["reference", "documented"])
def test_stream_of_alerts_equals_batch(spark, feed, tmp_path, mode):
    """One key with most rows, window edges and equal times, over the borders of micro-batches."""
    logs = table(spark, random_rows(3, 1500))
    out, query = run(jobs.stream_events(feed(logs)), tmp_path, jobs.counted_alerts(str(tmp_path / "counts"), mode=mode))
    expected = detect(parse(logs), mode=mode)
    assert sorted(r.alert_id for r in out.collect()) == sorted(r.alert_id for r in expected.collect())
    assert len(query.recentProgress) >= 4


def test_carried_matches_are_few_and_a_replay_changes_nothing(spark, tmp_path):
    counted = CountedRules(str(tmp_path / "counts"), delay=0)
    logs = table(spark, [(n * 1000, n, "9.9.9.9", "4xx") for n in range(3000)])
    for batch in (0, 1, 1, 2, 2):
        part = parse(logs.filter(F.col("event_id").between(batch * 1000, batch * 1000 + 999)))
        fired = {(r.event_id, r.rule_id) for r in counted.fire(part, batch).collect()}
        assert len(fired) == {0: 1000 - 10 + 1000 - 24}.get(batch, 2000)
        assert spark.read.parquet(str(tmp_path / f"counts/batch={batch}")).count() <= 52


def test_out_of_order_rows_see_what_came_before(spark, tmp_path):
    """Within the delay a row of a later micro-batch counts the earlier ones at or before its time."""
    counted = CountedRules(str(tmp_path / "counts"), delay=10)
    seconds = [[0, 1, 2, 3], [8, 9], [4, 5, 3]]
    fired, first = [], 0
    for batch, offsets in enumerate(seconds):
        rows = [(s * 1_000_000, first + k, "9.9.9.9", "ssh_fail") for k, s in enumerate(offsets)]
        first += len(offsets)
        fired.append({r.event_id for r in counted.fire(parse(table(spark, rows)), batch).collect()})
    assert fired == [set(), {4, 5}, {6, 7, 8}]


def test_stream_admission_equals_batch(spark, feed, tmp_path):
    rows = [(n, START + dt.timedelta(milliseconds=37 * n), "ab"[n % 5 == 0], "x") for n in range(1200)]
    logs = spark.createDataFrame(rows, schema.RAW_LOGS)
    admission = CountedAdmission(str(tmp_path / "instants"), limit=40, delay=0)
    out, _ = run(feed(logs), tmp_path, admission.admit)
    expected = {r.event_id for r in rate_limit(logs, limit=40).collect()}
    assert {r.event_id for r in out.collect()} == expected and len(expected) < 1200
    assert spark.read.parquet(str(tmp_path / "instants/batch=3")).count() <= 80  # instants of one window and source


def test_hours_change_after_they_were_written(spark, tmp_path):
    rows = [(n, START + dt.timedelta(minutes=17 * n), "s", "x") for n in range(60)]
    logs = spark.createDataFrame(rows, schema.RAW_LOGS)
    hours = KeyedCounts(spark, str(tmp_path / "hours"), "hour", whole=2)
    sink = hours.sink(hour_label(F.col("ts")))
    assert hours.now().count() == 0
    for batch, seen in ((0, [0]), (1, [0, 1]), (2, [0, 1, 2]), (2, [0, 1, 2]), (3, [0, 1, 2])):
        sink(logs.filter(F.col("event_id") % 3 == batch), batch)
        expected = logs.filter((F.col("event_id") % 3).isin(seen)).groupBy(hour_label(F.col("ts"))).count()
        assert {tuple(r) for r in hours.now().collect()} == {tuple(r) for r in expected.collect()}
    assert {tuple(r) for r in hours.now().collect()} == {(r.hour, r.n) for r in events_by_hour(logs, START + dt.timedelta(hours=20)).collect()}


def test_late_rows_are_data_and_ids_outlive_a_replay(spark, tmp_path):
    tables = RunTables(spark, str(tmp_path / "tables"))
    land = landing.land(tables, delay=10)
    parts = [[0, 1, 2, 3], [70, 71, 5], [61, 60, 59], [600], [], [5, 600, 590, 589]]
    batches = [spark.createDataFrame([(START + dt.timedelta(seconds=s), "s", f"{n}:{s}") for s in part], "ts timestamp_ntz, source string, raw string")
               for n, part in enumerate(parts)]
    for n, batch in enumerate(batches):
        land(batch.coalesce(1), n)
    assert {(r.raw, r.run) for r in landing.late_lines(tables).collect()} == {("2:60", 3), ("2:59", 3), ("5:5", 6), ("5:589", 6)}
    kept = spark.read.parquet(tables.path("landed"))
    ids = {r.raw: r.event_id for r in kept.select("raw", "event_id").collect()}
    assert len(ids) == 11 and ids["0:0"] == 0 and ids["5:600"] == 12
    land(batches[5].orderBy("raw"), 5)  # the same rows in another order
    again = RunTables(spark, str(tmp_path / "tables"))
    assert {r.raw: r.event_id for r in spark.read.parquet(again.path("landed")).select("raw", "event_id").collect()} == ids
    assert [tuple(r) for r in landing.landing_metrics(again).orderBy("batch").select("batch", "rows", "late").collect()] == [
        (0, 4, 0), (1, 3, 0), (2, 3, 2), (3, 1, 0), (4, 0, 0), (5, 4, 2)]


def test_a_text_stream_leaves_nothing_behind(spark, tmp_path):
    """Files to tables in several micro-batches; intermediate tables and landed lines go, limits and counts go on."""
    made = []
    whole = staging.work_folder(spark)
    before = set(os.listdir(whole))
    tables = RunTables(spark, str(tmp_path / "tables"))
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        (source / f"{n}.log").write_text("".join(f"Mar  1 12:00:00 gate sshd[{n}{k}]: Failed password for bob from 9.9.9.9\n" for k in range(3)))
        stream = logs.read_watched(spark, [(str(source), "auth")], stream=True, ts=F.lit(START + dt.timedelta(seconds=n)).cast("timestamp_ntz"))
        jobs.finish(jobs.start(stream, landing.land(tables), str(tmp_path / "landing"), available_now=True))
        jobs.finish(jobs.start(landing.landed(tables), landing.detect_into(tables, limited=True), str(tmp_path / "detection"), available_now=True))
        made.append(tables.events().count())
    assert made == [3, 6, 9] and tables.alerts().filter("rule_id = 'AUTH-001'").count() == 5
    assert {r.event_id for r in tables.events().filter("has_alert = 1").collect()} == {r.event_id for r in tables.alerts().collect()} == set(range(4, 9))
    assert set(os.listdir(whole)) == before and not list((tmp_path / "tables" / "_pending").glob("*"))


def test_text_files_as_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.log").write_text(" [1.0] segfault \n\n")
    out, _ = run(stream_lines(spark, str(tmp_path / "in"), "kernel").filter(F.col("raw") != ""), tmp_path)
    assert [(r.source, r.raw) for r in out.collect()] == [("kernel", "[1.0] segfault")]


def test_a_round_of_a_stream_comes_in_many_files(spark, tmp_path):
    """Rounds are stretches of ids; each is spread over files that are read by tasks of their own."""
    given = spark.range(400_000, numPartitions=4).select(F.col("id").alias("event_id"), F.md5(F.col("id").cast("string")).alias("raw"))
    rows = registry._in_rounds(given, 4)
    for k in range(4):
        path = str(tmp_path / f"round{k}")
        registry._arrive(rows.filter(F.col("round") == k).drop("round"), path)
        sizes = [r["n"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 100_000 and len(sizes) >= 4 and max(sizes) < 50_000


def test_landed_lines_of_one_split_are_read_by_many_tasks(spark, tmp_path):
    tables = RunTables(spark, str(tmp_path / "tables"))
    raw = F.md5(F.col("id").cast("string"))
    landing.land(tables)(spark.range(200_000, numPartitions=1).select(F.lit(START).cast("timestamp_ntz").alias("ts"), F.lit("app").alias("source"), raw.alias("raw")), 0)
    files = spark.read.parquet(tables.path("landed")).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in files) == 200_000 and len(files) >= 4 and max(r["n"] for r in files) < 80_000


def test_a_micro_batch_writes_what_fired_without_the_texts_of_the_rules(spark, tmp_path, monkeypatch):
    staged = []
    monkeypatch.setattr(landing, "stage", lambda rows, label: staged.append(rows.columns) or staging.stage(rows, label))
    tables = RunTables(spark, str(tmp_path / "tables"))
    landing.detect_into(tables)(table(spark, [(n * 1_000_000, n, "9.9.9.9", "ssh_fail") for n in range(8)]), 0)
    assert len(staged) == 2 and not any("description" in columns for columns in staged)
    found = tables.alerts().filter("rule_id = 'AUTH-001'").collect()
    assert sorted(r.event_id for r in found) == [4, 5, 6, 7] and all(r.description for r in found)
    assert {r.event_id for r in tables.events().filter("has_alert = 1").collect()} == {r.event_id for r in tables.alerts().collect()}


def test_dealt_rows_are_the_rounds_of_the_lines(spark, tmp_path):
    given = spark.range(500).selectExpr("id AS event_id", "id % 17 AS user_id", "element_at(array('error', 'view', 'other'), CAST(id % 3 + 1 AS INT)) AS event_type", "CAST(id AS DOUBLE) AS value")
    given.unionByName(given.limit(20)).write.parquet(str(tmp_path / "events.parquet"))
    wanted = registry._in_rounds(registry.lines(spark, str(tmp_path)), 16).select("event_id", "source", "raw", "round")
    assert sorted(registry._dealt(spark, str(tmp_path), 16).collect()) == sorted(wanted.collect())
