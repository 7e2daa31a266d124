"""Every query of the engine against its DuckDB twin."""

import pytest
from compare import connect, rows_of

from sextant.plans.oracle import SQL
from sextant.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_each_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_twin(spark, duck, name):
    names, got = rows_of(QUERIES[name](spark, SF).toPandas())
    wanted_names, wanted = rows_of(duck.sql(SQL[name]).df())
    assert names == wanted_names
    assert got == wanted
