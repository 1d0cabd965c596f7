"""Compares a registered query with its SQL in another engine, over the smallest test tables."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return str(value) if hasattr(value, "isoformat") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(spark, query, sql):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    found = query(spark, DATA)
    expected = connection.sql(sql)
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(expected.columns, expected.fetchall())
