import datetime as dt

import pytest
from pyspark.sql import functions as F

from logwarden.operators.detect import detect, flag_events
from logwarden.operators.enrich import unlocated
from logwarden.operators.parse import parse
from logwarden.plans import reports
from logwarden.plans.jobs import run_batch, submit
from logwarden.sources import fastlog, logs, snapshots, store
from logwarden.sources.runs import RunTables

NOW = dt.datetime(2024, 5, 20, 12, 0, 0, tzinfo=dt.timezone.utc)


def test_watch_list():
    assert logs.watch_list(["/a/b.log", ("/c/d.log", "d"), {"path": "/e/f"}, {"path": "/g", "name": "h"}, {"name": "x"}]) == [
        ("/a/b.log", "b.log"), ("/c/d.log", "d"), ("/e/f", "f"), ("/g", "h")]
    assert ("/var/log/auth.log", "auth") in logs.watch_list()


def test_read_watched_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b" one \r\ntwo\xff\n\n")
    (tmp_path / "b.log").write_bytes("drei é\n".encode())
    read = logs.read_watched(spark, [str(tmp_path / "a.log"), (str(tmp_path / "b.log"), "b")])
    assert {(r.source, r.raw) for r in read.collect()} == {("a.log", "one"), ("a.log", "two�"), ("a.log", ""), ("b", "drei é")}
    assert read.schema["ts"].dataType.simpleString() == "timestamp_ntz"
    numbered = logs.number_rows(read.filter(F.col("source") == "a.log"))
    assert [r.raw for r in numbered.orderBy("event_id").collect()] == ["one", "two�", ""]


def test_submit(spark, make_logs):
    rows = make_logs([(0, None, "Mar  1 1:00 h sshd[1]: accepted password for root"), (1, "x", ""), (2, "x", "hello")])
    assert {(r.event_id, r.alerts) for r in submit(rows).collect()} == {(0, 1), (2, 0)}
    assert logs.submitted(rows).orderBy("event_id").first().source == "api"


def test_fastlog(spark):
    lines = ["05/03/2026-14:53:26.404682  [**] [1:5003:1] TCP SYN Scan - SYN Flag [**] [Classification: Attempted Information Leak] "
             "[Priority: 2] {TCP} 192.168.7.1:40001 -> 192.168.7.9:8443", "garbage"]
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    row = fastlog.parse_fastlog(df).collect()
    assert len(row) == 1 and (row[0].sid, row[0].rev, row[0].msg, row[0].priority, row[0].proto) == (5003, 1, "TCP SYN Scan - SYN Flag", 2, "TCP")
    assert row[0].seen_at == dt.datetime(2026, 5, 3, 14, 53, 26, 404682) and row[0].dest == "192.168.7.9:8443"
    assert fastlog.with_word(df, "scan").count() == 1


LINES = [(n, "auth", "Mar  1 1:00 h sshd[1]: Failed password for x from 9.9.9.9") for n in range(7)] + [
    (8, "kernel", "[1.0] segfault"), (9, "Apache", '10.0.0.1 - - [x] "GET /../ HTTP" 404 1'), (10, "x", "plain")]


def test_batch_job_writes_both_tables(spark, make_logs, tmp_path):
    tables = RunTables(spark, str(tmp_path / "tables"))
    assert tables.events().count() == tables.alerts().count() == tables.claims().count() == 0
    events, alerts = run_batch(make_logs(LINES), tables)
    flags = {r.event_id: r.has_alert for r in events.collect()}
    assert flags == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 0}
    assert {r.rule_id for r in alerts.collect()} == {"AUTH-001", "SYS-002", "WEB-001"}
    assert events.filter("event_id = 8").first().source_lc == "apache"
    assert alerts.filter("rule_id = 'WEB-001'").first().geo.country == "Internal"
    # a second run appends under ids of its own
    events, alerts = run_batch(make_logs(LINES), tables)
    assert sorted(r.event_id for r in events.collect()) == list(range(20))
    details = reports.alert_details(alerts, events)
    assert details.count() == alerts.count() and alerts.filter("dt is null").count() == 0


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_broken_run_is_invisible_and_can_be_repeated(spark, make_logs, tmp_path, monkeypatch, step):
    tables = RunTables(spark, str(tmp_path / "tables"))
    run_batch(make_logs(LINES), tables, "a")

    def crash(self, claim, *rows):
        if rows:
            store.append_alerts(rows[1], self.path("alerts", f"run={claim.number}"), "overwrite")
        raise Crash

    with monkeypatch.context() as patch:
        patch.setattr(RunTables, step, crash)
        with pytest.raises(Crash):
            run_batch(make_logs(LINES[:8]), tables, "b")
    assert tables.events().count() == 10 and tables.alerts().filter("event_id >= 10").count() == 0
    events, alerts = run_batch(make_logs(LINES), tables, "c")
    assert sorted(r.event_id for r in events.collect()) == [*range(10), *range(18, 28)]
    times = sorted(r.ts for r in spark.read.parquet(tables.find("b").lines).collect())
    events, alerts = run_batch(make_logs(LINES), tables, "b")  # goes on with the lines it had written
    assert sorted(r.event_id for r in events.collect()) == list(range(28))
    assert sorted(r.ts for r in events.filter("event_id BETWEEN 10 AND 17").collect()) == times
    again = [sorted(map(repr, t.collect())) for t in (events, alerts)]
    assert [sorted(map(repr, t.collect())) for t in run_batch(make_logs(LINES), tables, "b")] == again
    assert alerts.join(events, "event_id", "left_anti").count() == 0


def test_runs_at_once_get_ids_of_their_own(spark, tmp_path, monkeypatch):
    one, two = RunTables(spark, str(tmp_path / "t")), RunTables(spark, str(tmp_path / "t"))
    first = one.claim("a", 5)
    seen = iter([[1]])  # what the slower run saw before the other one claimed
    monkeypatch.setattr(two, "_numbers", lambda folder: next(seen, None) or RunTables._numbers(two, folder))
    third, second = one.claim("b", 7), two.claim("c", 9)
    assert [(c.number, c.first_id, c.rows) for c in (first, third, second)] == [(1, 0, 5), (2, 5, 7), (3, 12, 9)]
    assert one.claim("c", 99) == second and not one.is_committed(second)
    one.commit(second)
    one.commit(second)
    assert two.is_committed(second)


def test_text_files_are_stored_whole(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {k}\n" for k in range(2000)))
    tables = RunTables(spark, str(tmp_path / "tables"))
    for _ in range(2):
        events, alerts = run_batch(logs.read_watched(spark, [(str(tmp_path / "a.log"), "app")]), tables)
    assert events.count() == 4000 and events.select("event_id").distinct().count() == 4000 and alerts.count() == 0
    assert events.select("raw").distinct().count() == 2000


def test_numbered_lines_of_one_split_reach_many_tasks(spark, tmp_path):
    """Most lines come in one split; numbering deals them out and changes neither order nor ids."""
    given = spark.range(200_000, numPartitions=1).unionByName(spark.range(200_000, 200_010, numPartitions=1))
    written = logs.write_lines(given.select(F.md5(F.col("id").cast("string")).alias("raw"), "id"), str(tmp_path / "lines"))
    found = logs.numbered(written, 7)
    assert found.filter(F.col("event_id") != F.col("id") + 7).count() == 0 and found.count() == 200_010
    found.write.parquet(str(tmp_path / "numbered"))
    sizes = [r["n"] for r in spark.read.parquet(str(tmp_path / "numbered")).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) < 80_000


def test_flags_say_what_the_alerts_hold(spark, make_logs):
    events = parse(make_logs(LINES))
    alerts = detect(events).filter("severity = 'HIGH'")
    expected = {r.event_id for r in alerts.collect()}
    assert {r.event_id for r in flag_events(events, alerts).filter("has_alert = 1").collect()} == expected
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert {r.event_id for r in flag_events(events, alerts).filter("has_alert = 1").collect()} == expected
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_older_alert_files_are_readable(spark, make_logs, tmp_path):
    path = str(tmp_path / "alerts")
    found = unlocated(detect(parse(make_logs(LINES))))
    found.drop("geo", "source_ip").write.parquet(path + "/dt=2024-01-01")
    store.append_alerts(found, path)
    read = store.read_alerts(spark, path)
    taken = snapshots.make_snapshot(spark, path, str(tmp_path / "saved"), NOW)
    snapshots.restore_snapshot(spark, taken, str(tmp_path / "again"))
    assert set(store.read_alerts(spark, str(tmp_path / "again")).select("alert_id", "source_ip").collect()) == set(
        read.select("alert_id", "source_ip").collect())
    assert read.count() == 2 * found.count() and read.filter("source_ip IS NULL").count() >= found.count()


def test_snapshots(spark, tmp_path):
    table, saved = str(tmp_path / "t"), str(tmp_path / "saved")
    spark.range(5).write.parquet(table)
    with pytest.raises(FileNotFoundError):
        snapshots.make_snapshot(spark, table + "x", saved)
    days = [dt.timedelta(days=d) for d in (20, 14, 1)]
    paths = [snapshots.make_snapshot(spark, table, saved, NOW - d) for d in days]
    assert [p for _, p in snapshots.list_snapshots(spark, saved)] == paths
    assert snapshots.expire_snapshots(spark, saved, 0, NOW) == 0
    assert snapshots.expire_snapshots(spark, saved, now=NOW) == 1  # exactly 14 days old stays
    assert [p for _, p in snapshots.list_snapshots(spark, saved)] == paths[1:]
    spark.range(3).write.mode("overwrite").parquet(table)
    with pytest.raises(FileExistsError):
        snapshots.restore_snapshot(spark, paths[1], table)
    before = snapshots.restore_snapshot(spark, paths[1], table, force=True, now=NOW)
    assert spark.read.parquet(store.data_folder(spark, table)).count() == 5 and snapshots.read_snapshot(spark, before).count() == 3
    assert snapshots.list_snapshots(spark, str(tmp_path), "t") == []  # what a restore saved is no snapshot
    assert snapshots.restore_snapshot(spark, paths[1], str(tmp_path / "new")) is None


def days(spark, *rows):
    return spark.createDataFrame([(n, f"0{d}") for n, d in rows], "n long, day string")


def held(spark, path):
    return sorted((r.n, r.day) for r in snapshots.read_snapshot(spark, path).collect())


def test_snapshots_share_what_did_not_change(spark, tmp_path):
    table, saved = str(tmp_path / "t"), str(tmp_path / "saved")
    taken, rows = [], []
    for n in range(3):
        rows.append((n, n % 2))
        days(spark, rows[-1]).write.mode("append").partitionBy("day").parquet(table)
        taken.append(snapshots.make_snapshot(spark, table, saved, NOW + dt.timedelta(days=10 * n)))
    assert [sorted(p.name for p in (tmp_path / "saved" / t.rsplit("/")[-1] / "data").glob("day=*")) for t in taken] == [["day=00"], ["day=01"], ["day=00"]]
    everything = sorted((n, f"0{d}") for n, d in rows)
    assert held(spark, taken[2]) == everything
    assert snapshots.expire_snapshots(spark, saved, 5, NOW + dt.timedelta(days=20)) == 2
    assert held(spark, taken[2]) == everything and not (tmp_path / "saved" / taken[0].rsplit("/")[-1]).exists()


def test_a_broken_restore_leaves_the_table(spark, tmp_path, monkeypatch):
    table, saved = str(tmp_path / "t"), str(tmp_path / "saved")
    days(spark, (1, 1)).write.partitionBy("day").parquet(table)
    taken = snapshots.make_snapshot(spark, table, saved, NOW)
    days(spark, (2, 1), (3, 2)).write.mode("overwrite").partitionBy("day").parquet(table)
    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "_measured", lambda rows, columns: {})
        with pytest.raises((ValueError, KeyError)):
            snapshots.restore_snapshot(spark, taken, table, force=True, now=NOW)
    now = spark.read.parquet(store.data_folder(spark, table))
    assert sorted(r.n for r in now.collect()) == [2, 3] and store.data_folder(spark, table) == table
    damaged = next((tmp_path / "saved").rglob("*.parquet"))
    spark.createDataFrame([(7,)], "n long").coalesce(1).write.mode("overwrite").parquet(str(damaged.parent))
    with pytest.raises(ValueError, match="damaged"):
        snapshots.restore_snapshot(spark, taken, table, force=True, now=NOW + dt.timedelta(days=1))
    assert store.data_folder(spark, table) == table
