"""Every named query against its DuckDB SQL on the smallest tables; those without SQL give rows of a stable schema."""

import pytest

from quillon import plans

from .compare import assert_same, connection
from .conftest import SF


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert_same(plans.queries()[name](spark, SF), con, plans.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs_without_sql(spark, name):
    first, again = (plans.queries()[name](spark, SF) for _ in range(2))
    assert first.schema == again.schema
    assert sorted(map(repr, first.collect())) == sorted(map(repr, again.collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
