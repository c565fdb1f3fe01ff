"""A sample of the registered queries against their SQL; ``verification.compare`` runs all."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from verification import registry
from verification.compare import rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["parse_events", "alerts_all", "alerts_all_documented", "rate_limit", "geo_enrich", "notify_payload", "signature_hits",
          "rule_stats", "stats_document", "clean_lines", "trailing_count", "submit_result", "rules_overridden",
          "committed_runs", "rule_custom_key", "stream_rule_custom_key", "geo_nested", "stream_job_from_text", "late_rows", "late_row_counts",
          "stream_events_by_hour", "stream_alerts"]


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(driver.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    df = driver.queries()[name](spark, FOLDER)
    result = db.execute(driver.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())
