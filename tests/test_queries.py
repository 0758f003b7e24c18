"""The registered queries against SQL on the smallest driver tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAMPLE = (
    "P3_equals_phrase P15_any_element T1_analyze A4_statistics_nested V8_command_rows V10_version_diff L2_link_errors "
    "L6_backward_references L13_nearest_neighbours T8_valency D1_derive_in_elements J6_flatten_paths"
).split()

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not there")


def plain(value):
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 140
    assert set(SAMPLE) <= set(sql)


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


@needs_data
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r.n_chars for r in rows] == sorted((r.n_chars for r in rows), reverse=True)


@needs_data
def test_patterns_of_one_file_are_read_by_all_cores(spark):
    rows = entry.queries()["T8_valency"](spark, FOLDER)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
