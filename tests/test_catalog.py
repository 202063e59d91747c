"""Every registered query against its oracle on the smallest data."""

from __future__ import annotations

import glob
import os

import pytest

from tessella import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def normal(rows):
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


def compare(spark, duck, run, sql):
    ours = run(spark, SF)
    theirs = duck.sql(sql)
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = [tuple(r[c] for c in columns) for r in ours.collect()]
    want = theirs.select(*[f'"{c}"' for c in columns]).fetchall()
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    compare(spark, duck, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
