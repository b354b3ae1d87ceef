"""Every query of the catalogue against its SQL on the smallest tables, and the entry point."""

import os

import duckdb
import pytest

import __spark_entry__
from stepweave.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return [columns[k] for k in order], sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sf_dir, duck, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    mine = rows_of(found.columns, [tuple(r) for r in found.collect()])
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        assert mine == rows_of(want.columns, want.fetchall())
    else:
        assert mine[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["from_state", "to_state", "weight"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
