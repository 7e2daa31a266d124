"""Tables in the shared folder, and what must still reach tasks once some exist."""

from compare import connect, rows_of

from sextant.plans import documents
from sextant.storage import stored

SF = "/root/testdata/sf0.001"


def test_rules_reach_tasks_after_a_table_was_stored(spark):
    assert stored(spark.range(3), "rows").count() == 3
    for name in ("saved_audit_match", "plan_audit_match", "family_matching", "research_matching"):
        assert rows_of(documents.QUERIES[name](spark, SF).toPandas()) == rows_of(connect(SF).sql(documents.SQL[name]).df())
