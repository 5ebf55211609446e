"""Every registered query of the engine runs; those with SQL agree with it."""

import pytest
from conftest import same_rows

from glintmark.queries import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    same_rows(catalogue.QUERIES[name](spark, sf_dir), duck, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
