"""Each query against the SQL that says the same, and entry()."""

import pytest
from conftest import rows_of

import __spark_entry__
from loamworks.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, sf, name):
    ours = rows_of(catalogue.QUERIES[name](spark, sf).toPandas())
    theirs = rows_of(duck.execute(catalogue.ORACLES[name]).df())
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
