import random

import pytest
from pyspark.sql import functions as F

from logwarden.functions import text
from logwarden.functions.clock import micros
from logwarden.operators.clean import clean, rate_limit
from models import admitted


def test_strip_cut_and_colours(make_logs):
    lines = ["  a \t", "", " 　 ", "\x1b[1;32mgreen\x1b[0m", "\x1b[31m", "x" * 20000, "\x1b[31m" + "y" * 20000]
    out = {r.event_id: r.raw for r in clean(make_logs([(n, "s", raw) for n, raw in enumerate(lines)]), False).collect()}
    assert out == {0: "a", 3: "green", 4: "", 5: "x" * 16384, 6: "y" * (16384 - 5)}


def model(df, limit, seconds):
    rows = df.select(micros(F.col("ts")).alias("us"), "event_id", "source").collect()
    return admitted(sorted((r.us, r.event_id, r.source) for r in rows), limit, seconds * 1_000_000)


def kept(df, **options):
    return [r.event_id for r in rate_limit(df, **options).collect()]


def test_flood_of_one_source(make_logs):
    rows = [(n / 501, "s", "x") for n in range(501)] + [(5.1, "s", "x"), (5.1, "t", "x")]
    out = kept(make_logs(rows))
    assert sorted(out) == [n for n in range(503) if n != 500]


def test_nothing_to_limit(make_logs):
    assert sorted(kept(make_logs([(n, "s", "x") for n in range(50)]))) == list(range(50))


@pytest.mark.parametrize("rows_a_batch", [10_000, 17])
@pytest.mark.parametrize("seed", [1, 2])
def test_limit_equals_sequential_model(spark, make_logs, seed, rows_a_batch):
    """Also where a busy stretch goes on over many Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    rng = random.Random(seed)
    at, rows = 0.0, []
    for _ in range(2500):
        at += rng.choice([0, 0, 0, 0.01, 0.1, 0.7]) if rng.random() < 0.985 else rng.choice([2.0, 5.0, 12.0])
        rows.append((round(at, 3), rng.choice("aaaab"), "x"))
    logs = make_logs(rows)
    out = kept(logs, limit=20, seconds=5)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(set(out))
    assert set(out) == model(logs, 20, 5)
    assert len(out) < len(rows)


def test_many_rows_at_one_instant(make_logs):
    logs = make_logs([(0, "s", "x")] * 300 + [(5, "s", "x")] * 5 + [(5.000001, "s", "x")] * 300)
    assert set(kept(logs, limit=100)) == model(logs, 100, 5) == set(range(100)) | set(range(305, 405))


def test_text_functions(spark):
    df = spark.createDataFrame([("abcd", "a%zz+%41%C3%A9%", "no address 1.2.3 but 1.22.3.444x 10.0.0.1")], "a string, q string, m string")
    row = df.select(
        text.entropy(F.col("a")).alias("e"), text.entropy(F.lit("")).alias("z"), text.percent_decode(F.col("q")).alias("q"),
        text.first_ipv4(F.col("m")).alias("ip"), text.display_time(F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")).alias("t"),
        text.first_label(F.lit("www.example.org")).alias("l"),
    ).first()
    assert (row.e, row.z, row.q, row.ip) == (2.0, 0.0, "a%zz+Aé%", "10.0.0.1")
    assert (row.t, row.l) == ("2024-01-02 03:04:05 UTC", "www")
