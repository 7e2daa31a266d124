"""Every query over the artifact layer against its DuckDB twin."""

import pytest
from compare import connect, rows_of

from sextant.artifacts.batch import judged
from sextant.plans import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", documents.QUERIES)
def test_query_equals_twin(spark, duck, name):
    assert set(documents.QUERIES) == set(documents.SQL)
    assert rows_of(documents.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.sql(documents.SQL[name]).df())


def test_text_that_is_no_document_is_a_problem(spark):
    rows = spark.createDataFrame([(None,), ("",), ("[1]",), ("{}",), ('{"a": 1}',)], "document string")
    found = [r.problem for r in judged(rows, "document", lambda x: x["a"]).collect()]
    assert [p is None for p in found] == [False, False, False, False, True]
