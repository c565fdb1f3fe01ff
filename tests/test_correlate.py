import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logwarden import schema
from logwarden.functions.clock import cell, micros
from logwarden.operators.correlate import trailing_count
from logwarden.operators.detect import detect, smallest_counts
from logwarden.operators.parse import parse
from logwarden.operators.rules import BUILT_IN, FollowUp, Rule, WindowCount, with_rule
from models import firing

START = dt.datetime(2024, 3, 1, 12, 0, 0)
LINES = {
    "ssh_fail": "Mar  1 12:00:00 gate sshd[1]: Failed password for bob{}",
    "su_fail": "Mar  1 12:00:00 gate su[1]: failed login{}",
    "accept": "Mar  1 12:00:00 gate sshd[1]: Accepted password for bob{}",
    "4xx": '{} - - [x] "GET /page HTTP/1.1" 404 1',
}


def line(kind, key):
    if kind == "4xx":
        return LINES[kind].format(key)
    return LINES[kind].format("" if key == "unknown" else f" from {key}")


def random_rows(seed, n):
    """Bursts, exact window edges, equal times, one key with most rows, and rows without address."""
    rng = random.Random(seed)
    us, rows = 0, []
    keys = ["9.9.9.9"] * 6 + ["8.8.8.8", "7.7.7.7", "unknown"]
    for event_id in range(n):
        us += rng.choice([0, 0, 1, 250_000, 1_000_000, 2_500_000, 20_000_000, 60_000_000]) if rng.random() < 0.7 else 100_000
        if rng.random() < 0.01:
            us += 300_000_000
        kind = rng.choice(["ssh_fail"] * 4 + ["su_fail", "accept", "accept", "4xx", "4xx", "4xx", "4xx"])
        key = rng.choice(keys)
        if kind == "4xx" and key == "unknown":
            key = "6.6.6.6"
        rows.append((us, event_id, key, kind))
    return rows


def table(spark, rows):
    data = [(e, START + dt.timedelta(microseconds=us), "x", line(kind, key)) for us, e, key, kind in rows]
    return spark.createDataFrame(data, schema.RAW_LOGS)


@pytest.mark.parametrize("mode", ["reference", "documented"])
@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_sequential_model(spark, mode, seed):
    rows = random_rows(seed, 4000)
    found = detect(parse(table(spark, rows)), mode=mode).filter(
        F.col("rule_id").isin("AUTH-001", "AUTH-005", "AUTH-006", "WEB-002", "WEB-004")
    )
    assert {(r.event_id, r.rule_id) for r in found.collect()} == firing(rows, mode)


def test_dense_burst_of_one_key_and_equal_times(spark):
    rows = [(min(n // 400, 3), n, "9.9.9.9", ["ssh_fail", "4xx", "accept"][n % 3]) for n in range(3000)]
    for mode in ("reference", "documented"):
        found = detect(parse(table(spark, rows)), mode=mode)
        assert {(r.event_id, r.rule_id) for r in found.collect()} == firing(rows, mode)


def test_stress_sequence(spark):
    rows = [(n * 100_000, n, "5.5.5.5", "ssh_fail") for n in range(12)]
    rows += [(2_000_000 + n * 50_000, 12 + n, "5.5.5.5", "4xx") for n in range(55)]
    rows += [(6_000_000, 67, "5.5.5.5", "accept")]
    logs = table(spark, rows).withColumn("raw", F.replace("raw", F.lit("bob"), F.lit("root")))

    def counts(mode):
        return Counter(r.rule_id for r in detect(parse(logs), mode=mode).collect())

    assert counts("reference") == {
        "AUTH-001": 8, "AUTH-002": 12, "AUTH-005": 3, "AUTH-003": 1, "AUTH-006": 1, "WEB-002": 45, "WEB-004": 31}
    assert counts("documented") == {
        "AUTH-001": 8, "AUTH-002": 12, "AUTH-005": 3, "AUTH-003": 1, "AUTH-006": 1, "WEB-002": 36, "WEB-004": 6}


def test_slow_guessing_differs_by_mode(spark):
    rows = [(s * 1_000_000, n, "5.5.5.5", "ssh_fail") for n, s in enumerate((0, 100, 200))]
    rows.append((210_000_000, 3, "5.5.5.5", "accept"))
    for mode, fires in (("reference", 0), ("documented", 1)):
        assert detect(parse(table(spark, rows)), mode=mode).count() == fires


def test_sql_injection_sequence(make_logs):
    web = '5.5.5.5 - - [x] "GET {} HTTP/1.1" 404 1'
    payloads = ["/search?id=1%20UNION%20SELECT%201", "/search?id=1%27+OR+%271%27%3D%271", "/products/1%27",
                "/search?id=1' OR '1'='1", "/items?f=7%20OR%20SLEEP(3)--"]
    found = detect(parse(make_logs([(n, "flask", web.format(p)) for n, p in enumerate(payloads)])))
    assert {(r.event_id, r.rule_id) for r in found.collect()} == {(0, "WEB-003"), (4, "WEB-003")}


def test_one_rule_alone_still_shares_its_counter(spark):
    rows = [(n, n, "5.5.5.5", "4xx") for n in range(30)]
    alone = detect(parse(table(spark, rows)), only=("WEB-002",))
    assert {r.event_id for r in alone.collect()} == set(range(10, 30))


def test_smallest_counts():
    assert smallest_counts(BUILT_IN, "reference")["web_4xx"] == {"WEB-002": 11, "WEB-004": 25}
    assert smallest_counts(BUILT_IN, "documented")["web_4xx"] == {"WEB-002": 20, "WEB-004": 50}
    assert smallest_counts(BUILT_IN, "reference")["ssh_fail"] == {"AUTH-001": 5}


def test_custom_rules(spark):
    def su_failed():
        return (F.col("category") == "auth") & (F.col("process") == "su")

    rules = with_rule(Rule("T-1", "n", "d", "LOW", "auth", None, su_failed, WindowCount("su", 2, 10)))
    rules = with_rule(Rule("T-2", "n", "d", "LOW", "auth", None, lambda: F.col("message").contains("Accepted"),
                           FollowUp("su", 1, 20)), rules)
    rows = [(0, 0, "1.1.1.1", "su_fail"), (10_000_000, 1, "1.1.1.1", "su_fail"), (20_000_001, 2, "1.1.1.1", "su_fail"),
            (40_000_001, 3, "1.1.1.1", "accept"), (40_000_002, 4, "1.1.1.1", "accept")]
    found = detect(parse(table(spark, rows)), rules, mode="documented", only=("T-1", "T-2"))
    assert {(r.event_id, r.rule_id) for r in found.collect()} == {(1, "T-1"), (3, "T-2")}
    with pytest.raises(ValueError):
        with_rule(rules[-1], rules)


def test_very_large_counts(spark):
    rule = Rule("T-3", "n", "d", "LOW", "web", None, lambda: F.col("status") == 404, WindowCount("any_404", 1200, 10))
    rows = [(n * 7_000, n, "1.1.1.1", "4xx") for n in range(1500)]
    found = detect(parse(table(spark, rows)), with_rule(rule), only=("T-3",))
    assert {r.event_id for r in found.collect()} == set(range(1199, 1500))


def test_trailing_count_equals_plain_counting(spark):
    rows = [(us, e, key) for us, e, key, _ in random_rows(5, 3000)] + [(7, 3000 + n, "9.9.9.9") for n in range(500)]
    rows.sort()
    df = spark.createDataFrame(rows, "us bigint, event_id bigint, key string").repartition(7)
    found = {r.event_id: r.recent for r in trailing_count(df, "key", F.col("us"), 60).collect()}
    by_key = {}
    for us, e, key in rows:
        times = by_key.setdefault(key, [])
        times.append(us)
        assert found[e] == sum(1 for t in times if t >= us - 60_000_000)
    assert len(found) == len(rows)


def test_micros_and_cells_do_not_depend_on_the_zone(spark):
    # 2024-03-10 02:30 does not exist in the session's zone
    moments = [dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), dt.datetime(2024, 3, 10, 2, 30, 0, 1)]
    df = spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz").select(micros(F.col("ts")).alias("us"))
    rows = df.select("us", cell(F.col("us"), 60_000_000).alias("cell")).collect()
    expected = [int((m - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for m in moments]
    assert [r.us for r in rows] == expected
    assert [r.cell for r in rows] == [us // 60_000_000 for us in expected]
