"""All queries against their SQL on small tables, as the driver does it."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from verdigris import catalog

SF = "/root/testdata/sf0.001"
#: Model fits take long and have no SQL.
SLOW = {"nested_out_of_fold", "out_of_fold_scores"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query_equals_its_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalog.ORACLES:
        found = tables.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())


def test_entry_is_the_flagship(spark):
    assert "sensitivity" in __spark_entry__.entry(spark).columns
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(__spark_entry__.queries())
