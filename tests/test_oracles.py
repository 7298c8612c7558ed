"""Every registered query that SQL can express gives the rows of its SQL; the others run."""

import pytest
from conftest import same_rows

from siftwood.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    same_rows(got, want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
