"""Contract relations over tables, and what is registered."""

import pytest
from compare import connect, rows_of

import __spark_entry__ as entry
from sextant.plans.relations import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_twin(spark, name):
    names, got = rows_of(QUERIES[name](spark, SF).toPandas())
    wanted_names, wanted = rows_of(connect(SF).sql(SQL[name]).df())
    assert names == wanted_names
    assert got == wanted and len(got) > 5


def test_registered_queries_have_successors():
    registered = entry.queries()
    assert not set(entry.UNREGISTERED) & set(registered) and set(entry.UNREGISTERED.values()) <= set(registered)
    assert set(entry.oracle_sql()) <= set(registered)
