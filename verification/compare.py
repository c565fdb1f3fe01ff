"""Run queries on Spark and DuckDB and compare rows: ``python -m verification.compare [name ...]``."""

import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from verification.registry import ORACLES, QUERIES

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("compare")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def main() -> int:
    spark, db = session(), duckdb.connect()
    for file in os.listdir(FOLDER):
        name = file.removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    bad = 0
    for name in sys.argv[1:] or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, FOLDER)
            mine = rows_of(df.columns, df.collect())
            spent = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name:32s} {sum(mine.values()):7d} {spent:6.2f}s", flush=True)
                continue
            start = time.time()
            result = db.execute(ORACLES[name])
            names = [c[0] for c in result.description]
            types = {c[0]: str(c[1]) for c in result.description}
            theirs = rows_of(names, result.fetchall())
            ok = sorted(names) == sorted(df.columns) and mine == theirs
            print(f"{'ok  ' if ok else 'FAIL'}  {name:32s} {sum(mine.values()):7d} {sum(theirs.values()):7d} "
                  f"{spent:6.2f}s {time.time() - start:6.2f}s", flush=True)
            kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
                     "TIMESTAMP": "timestamp_ntz", "DATE": "date"}
            for column, kind in df.dtypes:
                if column in types and kinds.get(types[column], types[column]) != kind:
                    print(f"      type of {column}: {kind} / {types[column]}")
            if not ok:
                bad += 1
                print("      only here", list((mine - theirs).items())[:2])
                print("      only there", list((theirs - mine).items())[:2])
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
