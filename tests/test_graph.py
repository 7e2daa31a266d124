"""Column rules against the rules for one document, and chains of pinned documents."""

import copy
import hashlib
import json

import pytest
from compare import connect, rows_of
from pyspark.sql import functions as F

from sextant.artifacts import bundles as B
from sextant.artifacts import columns as R
from sextant.artifacts import documents as D
from sextant.artifacts import graph as L
from sextant.artifacts import handoff as H
from sextant.plans import documents as P

SF = "/root/testdata/sf0.001"
GOOD = {
    "schema_version": D.BUNDLE, "bundle_id": "b", "as_of": "2025-01-01", "generated_at": "x", "domain": "crypto", "symbols": ["BTC-USD"],
    "consumer_contract": {"canonical_input": D.DERIVED, "compatible_profiles": [P.CONSUMER]}, "freshness": {"status": " Fresh ", "provider_timestamp": 5},
    D.DERIVED: {"BTC-USD": {"close": 1.5, "x": [1, {"y": None}]}}, "provenance": {f: "x" for f in D.PROVENANCE},
}
REPORT = {
    "schema_version": D.QUALITY, "artifact_type": "r", "quality_status": "warn", "input_csv": {"sha256": "b" * 64}, "selected_columns": {"date": "d"}, "source_columns": ["d"],
    "raw_row_count": 5, "normalized_row_count": 2, "dropped_row_count": 3, "max_gap_days": 0, "duplicate_date_count": -1, "failure_reasons": [], "warning_reasons": ["w"],
}
MISSING = object()


def _changed(document, path, value):
    made = inner = copy.deepcopy(document)
    for k in path[:-1]:
        inner = inner[k]
    if value is MISSING:
        inner.pop(path[-1], None)
    else:
        inner[path[-1]] = value
    return made


def _variants(document):
    values = [MISSING, None, "", " \t ", "text", 0, -3, True, 1.5, [], [""], ["a", "a "], ["a", 1], [{"My_Token": 1}], {}, {"a": {}}, {"a": {"b": {"COOKIE x": 1}}}]
    yield document
    for key, inner in document.items():
        for v in values:
            yield _changed(document, (key,), v)
            if isinstance(inner, dict):
                for k in inner:
                    yield _changed(document, (key, k), v)
    for k in ('say "password" no', "new", "token", "a\\", 'q"token'):
        yield _changed(document, ("more",), [[{k: "secret: \"token\": 1"}]])


AUDIT = P._audit()
RESEARCH = {**AUDIT, "consumption_mode": "offline_research", "runtime_injection_allowed": False, "research_transform": "t", "research_as_of": "x"}
ADAPTER = {"schema_version": D.ADAPTER, "strategy": "s", "signal_consumer": "c", "signal_handoff_index": "i", "signal_handoff_manifest": "", "signal_as_of": "x", "saved_runtime_plan_json": "", "saved_consumption_audit_json": "", "accepted_freshness_statuses": ["fresh"], "require_all_known_families": False}
PLAN_FIELDS = [f if isinstance(f, str) else f[0] for f in H._PLAN]


@pytest.mark.parametrize(
    "document, one, many",
    [
        (GOOD, B.validate_bundle, R.bundle_rules), (REPORT, B.validate_quality, R.quality_rules), (AUDIT, H.validate_audit, R.audit_rules), (RESEARCH, H.validate_audit, R.audit_rules),
        (H.injection_plan(AUDIT), H.validate_plan, lambda v: R.plan_rules(v, PLAN_FIELDS)), (ADAPTER, H.validate_adapter, R.adapter_rules),
    ],
)
def test_column_rules_equal_the_rules_for_one_document(spark, document, one, many):
    texts = [json.dumps(x) for x in _variants(document)] + ["[]", "", "{", "null", "3", '"x"']

    def accepted(text):
        try:
            found = json.loads(text)
            assert isinstance(found, dict)
            one(found)
        except Exception:
            return False
        return True

    v = R.parsed(F.col("t"))
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i long, t string").withColumn("problem", R.problem(v, many(v)))
    got = {r.i: r.problem for r in rows.collect()}
    differ = [(t, got[i]) for i, t in enumerate(texts) if accepted(t) != (got[i] is None)]
    assert not differ and got[len(texts)] == "not an object" and None in got.values()


def test_rules_run_without_python(spark):
    for query in (P.bundle_validation, P.bundle_for_consumer, P.quality_documents, P.audit_documents, P.plan_audit_documents, P.adapter_documents):
        assert "Python" not in query(spark, SF)._jdf.queryExecution().executedPlan().toString() and "InArrow" not in query(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bundle_validation", "bundle_for_consumer", "quality_documents", "publication_chains", "audit_documents", "plan_audit_documents", "adapter_documents"])
def test_query_equals_twin(spark, name):
    names, got = rows_of(P.QUERIES[name](spark, SF).toPandas())
    wanted_names, wanted = rows_of(connect(SF).sql(P.SQL[name]).df())
    assert names == wanted_names
    assert got == wanted


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _judged(spark, documents):
    return {r.path: (r.problem, r.chain) for r in L.judged(spark.createDataFrame(documents, "path string, text string")).collect()}


def test_failures_travel_along_links(spark):
    c = json.dumps({"schema_version": D.QUALITY})
    b = json.dumps({"z_path": "c.json", "z_sha256": _sha(c), "a_path": "gone.json", "a_sha256": "0"})
    a = json.dumps({"next_path": "d/b.json", "next_sha256": _sha(b), "up_path": "../x.json", "up_sha256": "0", "plain": 1})
    whole = json.dumps({"one_path": "ok.json", "one_sha256": _sha("{}")})
    found = _judged(spark, [("a.json", a), ("d/b.json", b), ("d/c.json", c), ("w.json", whole), ("ok.json", "{}"), ("bad.json", "["), (None, "{}"), ("n.json", None)])
    assert found == {
        "a.json": ("the linked document doesn't exist", "next/a"), "d/b.json": ("the linked document doesn't exist", "a"),
        "d/c.json": ("quality report needs artifact_type", ""), "w.json": (None, None), "ok.json": (None, None), "bad.json": ("not an object", ""),
    }


def test_an_earlier_link_wins_however_deep(spark):
    bad = json.dumps({"schema_version": D.QUALITY})
    x = json.dumps({"y_path": "bad.json", "y_sha256": _sha(bad)})
    top = json.dumps({"a_path": "x.json", "a_sha256": _sha(x), "b_path": "bad.json", "b_sha256": "other"})
    root = json.dumps({"t_path": "top.json", "t_sha256": _sha(top)})
    found = _judged(spark, [("bad.json", bad), ("x.json", x), ("top.json", top), ("root.json", root)])
    assert found["top.json"] == ("quality report needs artifact_type", "a/y") and found["root.json"] == ("quality report needs artifact_type", "t/a/y")


def test_empty_and_cyclic_tables(spark):
    assert _judged(spark, []) == {}
    a, b = ({"n_path": f"{x}.json", "n_sha256": "1"} for x in "ba")
    assert all(p == "the linked document doesn't have the pinned hash" for p, _ in _judged(spark, [("a.json", json.dumps(a)), ("b.json", json.dumps(b))]).values())


def test_the_least_text_of_a_path_counts(spark):
    good, bad = json.dumps({"a": 1}), json.dumps({"b_path": "gone.json", "b_sha256": "0"})
    top = json.dumps({"x_path": "x.json", "x_sha256": _sha(min(good, bad))})
    found = _judged(spark, [("x.json", bad), ("x.json", good), ("x.json", good), ("top.json", top), ("y.json", bad), ("y.json", bad)])
    assert good < bad and found == {"x.json": (None, None), "top.json": (None, None), "y.json": ("the linked document doesn't exist", "b")}


def test_a_document_of_a_chain_is_parsed_once(spark):
    from sextant.artifacts.graph import _nodes

    plan = _nodes(spark.createDataFrame([("a", "{}")], "path string, text string"), None)
    made = [p for p in plan.inputFiles()]
    assert all("/facts-" in p for p in made)  # what follows reads facts, not texts


def test_facts_of_paths_that_come_once_are_not_shuffled(spark, monkeypatch):
    """All facts went through an aggregate by path, though hardly any path comes twice."""
    made, stored = {}, L.stored

    def kept(df, name):
        made[name] = df
        return stored(df, name)

    monkeypatch.setattr(L, "stored", kept)
    rows = [("a", json.dumps(GOOD)), ("b", json.dumps(REPORT)), ("c", "no object")]
    single = {r.path: r.problem for r in L.judged(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert single == {"a": None, "b": None, "c": "not an object"} and "nodes" not in made
    more = [*rows, rows[0], ("c", json.dumps(REPORT)), ("d", "{}"), ("d", "{} ")]
    found = {r.path: r.problem for r in L.judged(spark.createDataFrame(more, "path string, text string")).collect()}
    assert len(more) > len(found) == 4 and found["a"] is None and found["c"] == ("not an object" if "no object" < json.dumps(REPORT) else None)
