import pytest
from oracle import same

from aquabill import queries

import __spark_entry__ as entry


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, entry.queries()[name], queries.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 9


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
