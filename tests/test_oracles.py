"""Every query with an oracle gives what DuckDB gives on the same tables."""

from decimal import Decimal

import duckdb
import pytest

from tidebook.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


def plain(x):
    if isinstance(x, Decimal):
        return int(x) if x == int(x) else float(x)
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    rows = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
