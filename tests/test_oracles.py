"""Every registered query against its SQL on the smallest tables."""

import check_oracles
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_oracles.duck(SF)


def test_every_query_has_an_oracle():
    from loomset.plans.catalog import QUERIES

    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert check_oracles.compare(got.toPandas(), rel.df()) is None
    for column, kind in got.dtypes:
        assert check_oracles.same_type(kind, types[column]), (column, kind, types[column])
