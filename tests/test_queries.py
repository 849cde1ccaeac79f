"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from factloom.plans import catalog, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(rows):
    return sorted(repr(tuple(round(float(v), 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    order = [want.columns.index(c) for c in cols]
    assert norm(tuple(r) for r in got.select(*cols).collect()) == norm(tuple(r[i] for i in order) for r in want.fetchall())


def test_entry_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
