"""Every query of the library against its SQL, and the entry points."""

from __future__ import annotations

import pytest

import __spark_entry__
from conftest import SMALL, rows
from strandline.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck):
    got, want = catalog.queries()[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_query_without_sql_gives_rows_once(name, spark):
    """Other tests hold their values against plain versions; here, that they find something and the same again."""
    df = catalog.queries()[name](spark, SMALL)
    got = sorted(map(str, df.collect()))
    assert got and got == sorted(map(str, catalog.queries()[name](spark, SMALL).collect()))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    found = df.collect()
    assert found and [r["risk"] for r in found] == sorted((r["risk"] for r in found), key=["high", "medium", "low"].index)


def test_registered_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
