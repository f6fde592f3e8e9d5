"""Queries side by side with their SQL in DuckDB: python -m tests.compare SF_DIR [NAME...]"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return db


def plain(x):
    """A value without what differs between the engines' Python types."""
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


def difference(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What is wrong, or nothing."""
    wanted = db.execute(sql)
    names = [c[0] for c in wanted.description]
    a, b = rows(df.columns, df.collect()), rows(names, wanted.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(a) != len(b):
        return f"{len(a)} rows, not {len(b)}"
    return next((f"{x} instead of {y}" for x, y in zip(a, b) if x != y), "")


def main(sf_dir: str, *names: str) -> int:
    import __spark_entry__ as e

    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db, sql, bad = database(sf_dir), e.oracle_sql(), 0
    for name, query in e.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            said = difference(df, db, sql[name]) if name in sql else f"no SQL; {df.count()} rows"
        except Exception as error:
            said = f"{type(error).__name__}: {str(error)[:300]}"
        wrong = bool(said) and not said.startswith("no SQL")
        bad += wrong
        print(f"{'BAD ' if wrong else 'ok  '} {name} {time.time() - began:.1f}s {said}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(*sys.argv[1:])))
