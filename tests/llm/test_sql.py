"""The registered queries against their SQL on the small tables."""

import os

import duckdb
import pytest

from logwarden.llm import queries
from verification.compare import rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    df = queries.QUERIES[name](spark, FOLDER)
    result = db.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_returns_every_row(spark, name):
    table = "embeddings" if "whitening" in name else "documents"
    given = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    found = queries.QUERIES[name](spark, FOLDER).count()
    assert found == 32 * given if table == "embeddings" else found >= given
