"""Work per document: parsed once, written once, judged once."""

import pytest
from pyspark.sql import functions as F

from sextant.plans import documents as P

SF = "/root/testdata/sf0.001"
PARSES = {"bundle_validation": 1, "bundle_for_consumer": 1, "quality_documents": 1, "audit_documents": 1, "plan_audit_documents": 2, "adapter_documents": 1}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", PARSES)
def test_a_document_is_parsed_once(spark, name):
    # The parser's call is named once or twice for each place that parses.
    spark.conf.set("spark.sql.debug.maxToStringFields", 10000)
    assert _plan(P.QUERIES[name](spark, SF)).lower().count("parsejson(") <= 2 * PARSES[name]


def test_changes_of_a_document_do_not_multiply_it(spark):
    document = {f"f{i}": i for i in range(30)}
    made = P._filled(document, [(F.col("id") == 0, f, F.lit('"x"')) for f in document] + [(F.col("id") == 1, "f3", F.lit("null"))])
    rows = [r.t for r in spark.range(3).orderBy("id").select(made.alias("t")).collect()]
    assert [r.count('"x"') for r in rows] == [30, 0, 0] and '"f3": null' in rows[1] and '"f29": 29}' in rows[2]


@pytest.mark.parametrize("name", ["catalog_validation", "registry_validation"])
def test_a_variant_is_judged_once(spark, name):
    plan = P.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    judged = plan[plan.index("MapInArrow"):]
    assert "Aggregate" in judged.split("orders", 1)[0]
