"""Every registered query against DuckDB, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from rosterloom import oracles
from rosterloom.queries import QUERIES

ORACLES = oracles.oracle_sql()
SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in ("orders", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    mine = QUERIES[name](spark, sf_dir)
    theirs = duck.sql(ORACLES[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    types = dict(zip(theirs.columns, map(str, theirs.types)))
    assert {c: SPARK_TO_DUCK[t] for c, t in mine.dtypes} == types
    order = [theirs.columns.index(c) for c in columns]
    expected = Counter(tuple(r[i] for i in order) for r in theirs.fetchall())
    assert expected
    assert Counter(tuple(r) for r in mine.select(*columns).collect()) == expected


def test_summary_is_sorted(spark, sf_dir):
    auns = [r.AUN for r in entry_points.entry(spark).collect()]
    assert auns == sorted(auns) and len(auns) == 24


# Sizes of the example results at the smallest scale.
SIZES = {"batch_semi_join": 1311, "one_sided_ids": 617, "linked_pairs": 1230, "unmatched_registry": 122,
         "unmatched_upload": 163, "duplicate_keys": 88, "duplicate_key_rows": 41, "many_to_many_keys": 1}


@pytest.mark.parametrize("name", sorted(SIZES))
def test_size(spark, name):
    assert QUERIES[name](spark, entry_points.SMALL).count() == SIZES[name]
