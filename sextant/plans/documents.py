"""Queries over the artifact layer: documents made from the driver's tables, judged by the code that commands run.

Each has a DuckDB twin that says from the table alone which documents must be accepted.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..artifacts import bundles as B
from ..artifacts import columns as R
from ..artifacts import documents as D
from ..artifacts import governance as G
from ..artifacts import graph as L
from ..artifacts import handoff as H
from ..artifacts.batch import judged, mapped
from ..sources import fixtures as X
from .contracts import CONSUMERS, DOMAINS, FAMILIES
from .oracle import COVERED, HAVE, NEED

Query = Callable[[SparkSession, str], DataFrame]
CONSUMER = "us_equity:ibit_smart_dca"
_REQUIRED = CONSUMERS[CONSUMER]["BTC-USD"]


def _month() -> Column:
    return F.month("o_orderdate")


def _priority() -> Column:
    return F.substring("o_orderpriority", 1, 1)


# ---- bundles, one per order


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, document): bundles of which many break a rule, as the order's columns say."""
    text = lambda **f: F.struct(*(c.alias(k) for k, c in f.items()))
    day, month = F.date_format("o_orderdate", "yyyy-MM-dd"), _month()
    when = lambda condition, value, other: F.when(condition, F.lit(value)).otherwise(F.lit(other) if isinstance(other, str) else other)
    profile = F.lit(CONSUMER)
    payload = F.create_map(F.lit("close"), F.col("o_totalprice"))
    provenance = text(**{f: F.lit("x") for f in D.PROVENANCE if f != "code_commit"}, code_commit=when(month == 7, " ", "c0ffee"))
    secret = text(**{f: F.lit("x") for f in D.PROVENANCE}, nested=text(Api_Key=F.lit("x")))
    document = lambda last: F.to_json(text(
        schema_version=when(F.col("o_orderstatus") == "P", "market_signal_bundle.v0", D.BUNDLE),
        bundle_id=when(F.col("o_totalprice") < 20000, " ", F.concat(F.lit("bundle."), F.col("o_custkey").cast("string"))),
        domain=F.lit("crypto"), as_of=day, generated_at=day,
        consumer_contract=text(
            canonical_input=when(_priority() == "3", "market_prices", D.DERIVED),
            compatible_profiles=F.when(_priority() == "4", F.array(profile, profile)).otherwise(F.array(profile)),
        ),
        symbols=F.when(month == 2, F.array(F.lit("BTC-USD"), F.lit("ETH-USD"))).otherwise(F.array(F.lit("BTC-USD"))),
        derived_indicators=F.create_map(F.lit("BTC-USD"), F.when(month == 3, F.map_filter(payload, lambda k, v: F.lit(False))).otherwise(payload)),
        freshness=text(provider_timestamp=when(month == 4, "", day), status=when(month == 5, "stale", when(month == 6, "FRESH", "fresh"))),
        provenance=last,
    ))
    made = F.when(month == 8, document(secret)).otherwise(document(provenance))
    return X.read(spark, d, "orders").select("o_orderkey", made.alias("document"))


def _accepted(rows: DataFrame, rules: Callable[..., list[R.Rule]]) -> DataFrame:
    """(o_orderkey, accepted) of (o_orderkey, document)."""
    return R.judged(rows, "document", rules).select("o_orderkey", F.col("problem").isNull().alias("accepted"))


def bundle_validation(spark: SparkSession, d: str) -> DataFrame:
    """Which bundles hold together."""
    return _accepted(_bundles(spark, d), R.bundle_rules)


def bundle_for_consumer(spark: SparkSession, d: str) -> DataFrame:
    """Which bundles serve a consumer: the order's month says how many required fields there are, its status
    spells symbol and fields and names the profile."""
    names = F.slice(F.array(*map(F.lit, _REQUIRED)), 1, F.least(_month(), F.lit(len(_REQUIRED))))
    names = F.when(F.col("o_orderstatus") == "F", F.transform(names, F.upper)).otherwise(names)
    payload = F.map_from_arrays(names, F.transform(names, lambda _: F.lit(1.0)))
    symbol = F.when(_priority() == "1", " btc-usd").when(_priority() == "2", "BTC-USD.US").when(_priority() == "3", "BTCUSD").otherwise("BTC-USD")
    profiles = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("other"))).otherwise(F.array(F.lit(CONSUMER)))
    document = F.to_json(F.struct(F.struct(profiles.alias("compatible_profiles")).alias("consumer_contract"), F.create_map(symbol, payload).alias(D.DERIVED)))
    rows = X.read(spark, d, "orders").select("o_orderkey", document.alias("document"))
    return _accepted(rows, lambda v, text: R.consumer_rules(v, CONSUMER))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, document): quality reports of which many break a rule, as the order's columns say."""
    month, count = _month(), F.col("o_custkey")
    struct = lambda **f: F.struct(*(c.alias(k) for k, c in f.items()))
    status = F.when(F.col("o_orderstatus") == "P", "fail").when(F.col("o_orderstatus") == "F", "warn").otherwise("pass")
    document = F.to_json(struct(
        schema_version=F.lit(D.QUALITY), artifact_type=F.lit("local_ohlcv_quality_report"), quality_status=F.when(month == 1, "ok").otherwise(status),
        input_csv=struct(sha256=F.when(month == 2, F.upper(F.sha2(F.lit("ab"), 256))).otherwise(F.sha2(count.cast("string"), 256))),
        selected_columns=struct(date=F.lit("d")), source_columns=F.when(month != 3, F.array(F.lit("d"))),
        raw_row_count=F.when(month == 4, -1 - count).otherwise(count), normalized_row_count=count, dropped_row_count=F.when(month != 5, count),
        duplicate_date_count=F.lit(-1), max_gap_days=F.when(month == 6, 1.5).otherwise(F.lit(2.0)).cast("decimal(3,1)"),
        failure_reasons=F.when(month == 7, F.array(F.lit("a"), F.lit(" a "))).otherwise(F.array().cast("array<string>")),
        warning_reasons=F.when(month == 8, F.array(F.lit(" \t"))).otherwise(F.array(F.lit("a"))), more=F.array(struct(deep=F.create_map(F.when(_priority() == "5", "X_Signed_URL").otherwise("plain"), F.lit("token")))),
    ))
    # Whole numbers of days are written as such.
    return X.read(spark, d, "orders").select("o_orderkey", F.regexp_replace(document, r"2\.0\b", "2").alias("document"))


def quality_documents(spark: SparkSession, d: str) -> DataFrame:
    """Which quality reports, one per order, keep their contract."""
    return _accepted(_reports(spark, d), R.quality_rules)


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): for each order a handoff that pins a manifest that pins a bundle and a quality report; the order's columns say
    which is broken, gone, changed since or of other content."""
    month, key = _month(), F.col("o_orderkey").cast("string")
    good = lambda c: F.regexp_replace(c, "market_signal_bundle.v0", D.BUNDLE)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    struct = lambda **f: F.struct(*(c.alias(k) for k, c in f.items()))
    bundle = F.to_json(struct(
        schema_version=F.when(F.col("o_orderstatus") == "P", "market_signal_bundle.v0").otherwise(D.BUNDLE), bundle_id=key, domain=F.lit("crypto"), as_of=day, generated_at=day,
        consumer_contract=struct(canonical_input=F.lit(D.DERIVED), compatible_profiles=F.array(F.lit(CONSUMER))), symbols=F.array(F.lit("BTC-USD")),
        derived_indicators=F.create_map(F.lit("BTC-USD"), F.create_map(F.when(month == 8, "password").otherwise("close"), F.col("o_totalprice"))),
        freshness=struct(provider_timestamp=day, status=F.lit("fresh")), provenance=struct(**{f: F.lit("x") for f in D.PROVENANCE}),
    ))
    report = F.to_json(struct(
        schema_version=F.lit(D.QUALITY), artifact_type=F.lit("r"), quality_status=F.when(month == 9, "fail").otherwise("pass"), input_csv=struct(sha256=F.sha2(key, 256)),
        selected_columns=struct(date=F.lit("d")), source_columns=F.array(F.lit("d")), raw_row_count=F.lit(3), normalized_row_count=F.lit(3), dropped_row_count=F.lit(0),
        failure_reasons=F.array().cast("array<string>"), warning_reasons=F.array().cast("array<string>"),
    ))
    # Documents are far larger than the orders and are judged where they are made, so orders are dealt out first, however few parts their file has.
    orders = X.read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = orders.select("o_orderkey", "o_orderdate", "o_orderstatus", bundle.alias("bundle"), report.alias("report"))
    manifest = F.to_json(struct(
        schema_version=F.lit(D.MANIFEST), bundle_path=F.when(month == 7, F.concat(F.lit("../"), key, F.lit("/bundle.json"))).otherwise("bundle.json"),
        bundle_sha256=F.sha2(F.when(month == 10, F.concat("bundle", F.lit(" "))).otherwise(F.col("bundle")), 256), bundle_id=F.when(month == 12, "other").otherwise(key), as_of=day,
        canonical_input=F.lit(D.DERIVED), freshness_status=F.lit("fresh"), bundle_schema_version=F.get_json_object("bundle", "$.schema_version"),
        quality_report_path=F.when(month == 11, "gone.json").otherwise("quality.json"), quality_report_sha256=F.sha2("report", 256),
    ))
    rows = rows.withColumn("manifest", manifest)
    folder = F.concat(F.lit("p/"), key, F.lit("/"))
    handoff = F.to_json(struct(
        schema_version=F.lit(D.HANDOFF), bundle_id=F.when(month == 12, "other").otherwise(key), as_of=day, canonical_input=F.lit(D.DERIVED),
        bundle_manifest_path=F.concat(key, F.lit("/manifest.json")), bundle_manifest_sha256=F.sha2("manifest", 256),
    ))
    at = lambda name, text: F.struct(F.concat(folder, F.lit(name)).alias("path"), text.alias("text"))
    four = F.array(at("bundle.json", F.col("bundle")), at("quality.json", F.col("report")), at("manifest.json", F.col("manifest")), F.struct(F.concat(F.lit("p/"), key, F.lit(".handoff.json")).alias("path"), handoff.alias("text")))
    return rows.select(F.explode(four).alias("d")).select("d.path", "d.text")


def publication_chains(spark: SparkSession, d: str) -> DataFrame:
    """(path, problem, chain) of every order's handoff: the first thing wrong in its chain, and the links that lead there."""
    return L.judged(_chains(spark, d)).where("path like '%.handoff.json'")


def _filled(document: Mapping[str, Any], changes: list[tuple[Column, str, Column]]) -> Column:
    """The document as JSON in which each change replaces the value of a field of its own where its condition holds."""
    text, by_field = json.dumps(document), {}
    for when, field, value in changes:
        by_field.setdefault(field, []).append((when, value))
    pieces: list[Column] = []
    # What is between the changed fields stays as it is, so the document is written once, however many changes there are.
    for field in sorted(by_field, key=lambda f: text.index(f'"{f}": ')):
        old = json.dumps(document[field])
        before, text = text.split(f'"{field}": {old}', 1)
        made = F.lit(old)
        for when, value in by_field[field]:
            made = F.when(when, value).otherwise(made)
        pieces += [F.lit(f'{before}"{field}": '), made]
    return F.concat(*pieces, F.lit(text))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def audit_documents(spark: SparkSession, d: str) -> DataFrame:
    """Which audits, one per order, keep their contract; status picks the mode, month and priority what is wrong."""
    month, always = _month(), F.lit(True)
    research = F.col("o_orderstatus") == "F"
    document = _filled({**_audit(), "research_transform": "t", "research_as_of": "2025-01-01"}, [
        (research, "consumption_mode", F.lit('"offline_research"')), (research | (month == 1), "runtime_injection_allowed", F.lit("false")),
        (always, "bundle_id", _quoted(F.when(month == 2, F.lit(" ")).otherwise(F.col("o_custkey").cast("string")))),
        (month == 3, "research_as_of", F.lit("null")), (month == 4, "local_registry_payload_sha256", _quoted(F.upper(F.sha2(F.lit("ab"), 256)))),
        (_priority() == "1", "ready_for_consumption", F.lit("1")), (_priority() == "2", "source_families", F.lit('[{"a": {"Cookie": "x"}}]')),
    ])
    return _accepted(X.read(spark, d, "orders").select("o_orderkey", document.alias("document")), R.audit_rules)


def plan_audit_documents(spark: SparkSession, d: str) -> DataFrame:
    """Which plans agree with their audits: both carry the order's numbers, the audit its day where the plan has its month."""
    audited = _audit()
    plan = _filled(H.injection_plan(audited), [(F.lit(True), "as_of", _quoted(_month().cast("string"))), (F.lit(True), "bundle_id", _quoted(F.col("o_custkey").cast("string")))])
    audit = _filled(audited, [
        (F.lit(True), "as_of", _quoted(F.dayofmonth("o_orderdate").cast("string"))), (F.lit(True), "bundle_id", _quoted(F.col("o_custkey").cast("string"))),
        (_priority() == "5", "matched_source_families", F.lit("[]")),
    ])
    fields = [(f, f) if isinstance(f, str) else f for f in H._PLAN]
    rows = X.read(spark, d, "orders").select("o_orderkey", plan.alias("plan"), audit.alias("audit"))
    rows = rows.withColumns({"p": R.parsed(F.col("plan")), "a": R.parsed(F.col("audit"))})
    p, a = F.col("p"), F.col("a")
    own = F.coalesce(R.problem(p, R.plan_rules(p, [x for x, _ in fields], F.col("plan"))), R.problem(a, R.audit_rules(a, F.col("audit"))))
    return rows.select("o_orderkey", F.coalesce(own, R.problem(p, [R.same(p, a, fields, "plan and audit")])).isNull().alias("accepted"))


def adapter_documents(spark: SparkSession, d: str) -> DataFrame:
    """Which adapter configs, one per order, keep their contract."""
    month, base = _month(), {
        "schema_version": D.ADAPTER, "strategy": "s", "signal_consumer": CONSUMER, "signal_handoff_index": "", "signal_handoff_manifest": "", "signal_as_of": "",
        "saved_runtime_plan_json": None, "saved_consumption_audit_json": None, "accepted_freshness_statuses": ["fresh"], "require_all_known_families": False,
    }
    status = F.col("o_orderstatus")
    document = _filled(base, [
        (status != "F", "signal_handoff_index", F.lit('"i.json"')), (status != "O", "signal_handoff_manifest", F.lit('"m.json"')),
        (month > 2, "signal_as_of", _quoted(F.date_format("o_orderdate", "yyyy-MM-dd"))), (month == 5, "saved_runtime_plan_json", F.lit('"p.json"')),
        (_priority() == "1", "saved_consumption_audit_json", F.lit('"a.json"')), (month == 6, "require_all_known_families", F.lit('"yes"')),
        (month == 7, "accepted_freshness_statuses", F.lit("[]")), (_priority() == "2", "signal_consumer", F.lit('"research:x"')),
    ])
    return _accepted(X.read(spark, d, "orders").select("o_orderkey", document.alias("document")), R.adapter_rules)


# ---- families of bundles and exports

_TRANSFORMS = sorted({f["transform"] for f in FAMILIES.values()})
_POLICIES = sorted({f["freshness_policy"] for f in FAMILIES.values()})
_SYMBOLS = ("BTC-USD", "qqq", "SPY.US", "SOXL", "US-EQUITY-CONTEXT")
_FIELDS = ("CLOSE", "rsi14", "vix_percentile", "price", "ahr999")


def _picked(values: tuple[str, ...] | list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def family_matching(spark: SparkSession, d: str) -> DataFrame:
    """Families that fit the bundles of parts of orders: transform, policy, symbol, field and consumer go by the row's keys."""
    document = F.to_json(F.struct(
        _picked(_TRANSFORMS, F.col("l_partkey")).alias("transform"), _picked(_POLICIES, F.col("l_suppkey")).alias("freshness_policy"),
        F.array(_picked(_SYMBOLS, F.col("l_orderkey"))).alias("symbols"),
        F.create_map(F.lit("x"), F.array(_picked(_FIELDS, F.col("l_linenumber")))).alias("indicator_fields_by_symbol"),
    ))
    rows = X.read(spark, d, "lineitem").select(document.alias("document")).groupBy("document").agg(F.count(F.lit(1)).alias("bundles"))
    found = mapped(rows, "document", lambda t: ",".join(sorted(H.matching_families(FAMILIES.values(), json.loads(t), None))), "families")
    return found.groupBy("families").agg(F.sum("bundles").alias("bundles"))


def research_matching(spark: SparkSession, d: str) -> DataFrame:
    """Families that fit exports: transform and consumer go by part and supplier."""
    consumers = sorted(CONSUMERS)
    rows = X.read(spark, d, "lineitem").select(F.concat_ws("|", _picked(_TRANSFORMS, F.col("l_partkey")), _picked(consumers, F.col("l_suppkey"))).alias("export"))
    rows = rows.groupBy("export").agg(F.count(F.lit(1)).alias("exports"))
    return mapped(rows, "export", lambda t: ",".join(sorted(H.research_families(FAMILIES.values(), *t.split("|")))), "families")


# ---- governance


def governance_coverage(spark: SparkSession, d: str) -> DataFrame:
    """(family, consumer, missing): what a family's record lacks of its consumers' requirements, then of all others'."""
    rows = [(f, c, ",".join(sorted(x))) for f, r in FAMILIES.items() for c, x in G.coverage({**r, "compatible_profiles": sorted(CONSUMERS)}).items()]
    return spark.createDataFrame(rows, "family string, consumer string, missing string")


def governance_ownership(spark: SparkSession, d: str) -> DataFrame:
    """(consumer, kind, families, missing, covered) of the ownership matrix."""
    rows = [
        (r["consumer"], r["consumer_kind"], ",".join(r["source_families"]), ",".join(r["missing_required_fields"]), r["all_required_fields_covered"])
        for r in G.ownership_matrix()["consumers"]
    ]
    return spark.createDataFrame(rows, "consumer string, kind string, families string, missing string, covered boolean")


def governance_runtime(spark: SparkSession, d: str) -> DataFrame:
    """(consumer, families) of the runtime coverage, by domain's families alone and of all."""
    rows = []
    for domain in (*sorted(DOMAINS), "all"):
        found = G.runtime_coverage([f for f in FAMILIES.values() if domain in ("all", f["domain"])])
        rows += [(domain, c, ",".join(sorted(x)), c in found["runtime_consumers_without_source_family"], found["all_runtime_consumers_covered"]) for c, x in found["runtime_consumer_source_families"].items()]
    return spark.createDataFrame(rows, "domain string, consumer string, families string, bare boolean, all_covered boolean")


def registry_fields(spark: SparkSession, d: str) -> DataFrame:
    """(consumer, symbol, position, field) of the registry document."""
    rows = [(c["consumer"], s, i, f) for c in G.registry()["contracts"] for s, fields in c["required_indicator_fields_by_symbol"].items() for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "consumer string, symbol string, position int, field string")


def catalog_fields(spark: SparkSession, d: str) -> DataFrame:
    """(family, domain, transform, policy, symbol, field) of the catalog document."""
    rows = [(r["family"], r["domain"], r["transform"], r["freshness_policy"], s, f) for r in G.catalog()["families"] for s in r["symbols"] for f in r["derived_indicator_fields"]]
    return spark.createDataFrame(rows, "family string, domain string, transform string, policy string, symbol string, field string")


# ---- documents in variants: one valid form and ways to break it


def _changed(document: Mapping[str, Any], *path: Any, value: Any = None, drop: bool = False) -> dict[str, Any]:
    made = copy.deepcopy(dict(document))
    inner: Any = made
    for key in path[:-1]:
        inner = inner[key]
    if drop:
        del inner[path[-1]]
    else:
        inner[path[-1]] = value
    return made


def _audit() -> dict[str, Any]:
    digest = "a" * 64
    return {
        "schema_version": D.AUDIT, "consumer": CONSUMER, "consumption_mode": "runtime_platform", "ready_for_consumption": True, "ready_for_runtime_injection": True,
        "runtime_injection_allowed": True, "research_csv_runtime_injection_allowed": False, "linked_manifest_sha256s_verified": True, "consumer_contract_verified": True,
        "source_catalog_verified": True, "handoff_manifest_path": "h.json", "handoff_manifest_sha256": digest, "bundle_id": "b", "as_of": "2025-01-01",
        "runtime_market_data_key": D.DERIVED, "runtime_payload_field": D.DERIVED, "canonical_input": D.DERIVED, "freshness_status": "fresh",
        "signal_bundle_manifest_path": "m.json", "signal_bundle_manifest_sha256": digest, "source_family_catalog_manifest_sha256": digest,
        "consumer_contract_registry_manifest_sha256": digest, "canonical_registry_payload_sha256": digest, "local_registry_payload_sha256": digest,
        "local_contract_registry_verified": True, "source_families": ["crypto.btc_cycle_daily"], "matched_source_families": ["crypto.btc_cycle_daily"],
        "consumer_contracts": [CONSUMER],
    }


def _variants() -> dict[str, tuple[Callable[[Mapping[str, Any]], Any], list[tuple[str, dict[str, Any], bool]]]]:
    """By kind: the rule, and (name, document, whether it must be accepted)."""
    registry, catalog, audited = G.registry(), G.catalog(), _audit()
    plan = H.injection_plan(audited)
    contract, family = registry["contracts"][0], catalog["families"][0]
    report = {
        "schema_version": D.QUALITY, "artifact_type": "local_ohlcv_quality_report", "quality_status": "warn", "input_csv": {"sha256": "b" * 64}, "selected_columns": {"date": "d"},
        "source_columns": ["d"], "raw_row_count": 5, "normalized_row_count": 2, "dropped_row_count": 3, "min_history_rows": 1, "max_allowed_gap_days": 1, "max_gap_days": 4,
        "failure_reasons": [], "warning_reasons": ["invalid_dates_dropped"],
    }
    adapter = {"schema_version": D.ADAPTER, "strategy": "s", "signal_consumer": CONSUMER, "signal_handoff_index": "i.json", "signal_as_of": "2025-01-01", "accepted_freshness_statuses": ["fresh"]}
    legacy = {**catalog, "families": [{k: v for k, v in f.items() if k != "source_profiles"} for f in catalog["families"]]}
    fields = [(f, f) if isinstance(f, str) else f for f in H._PLAN]
    kinds: dict[str, tuple[Callable[[Mapping[str, Any]], Any], list[tuple[str, dict[str, Any], bool]]]] = {
        "registry_validation": (lambda x: G.validate_registry(x, complete=x.pop("_complete", False)), [
            ("whole", registry, True), ("whole_complete", {**registry, "_complete": True}, True),
            ("partial", {**registry, "contracts": [contract]}, True), ("partial_complete", {**registry, "contracts": [contract], "_complete": True}, False),
            ("drifted_symbol", _changed(registry, "contracts", 0, "required_indicator_fields_by_symbol", value={"X": ["close"]}), False),
            ("repeated", {**registry, "contracts": [contract, contract]}, False), ("none", {**registry, "contracts": []}, False),
            ("unknown_consumer", _changed(registry, "contracts", 0, "consumer", value="who"), False), ("other_input", {**registry, "canonical_input": "prices"}, False),
            ("other_schema", {**registry, "schema_version": "v0"}, False), ("sensitive", {**registry, "notes": [{"my_Password": 1}]}, False),
        ]),
        "catalog_validation": (lambda x: G.validate_catalog(x, complete=x.pop("_complete", False)), [
            ("whole", catalog, True), ("whole_complete", {**catalog, "_complete": True}, True), ("without_profiles", legacy, True),
            ("without_domains", {k: v for k, v in catalog.items() if k != "domain_coverage"}, True), ("partial", {**catalog, "families": [family]}, True),
            ("partial_complete", {**catalog, "families": [family], "_complete": True}, False), ("drifted", _changed(catalog, "families", 0, "transform", value="x"), False),
            ("profile_without_policy", _changed(catalog, "families", 0, "source_profiles", 0, "research_use_policy", drop=True), False),
            ("profile_renamed", _changed(catalog, "families", 0, "source_profiles", 0, "source_name", value="x"), False),
            ("repeated", {**catalog, "families": [family, family]}, False), ("unknown", _changed(catalog, "families", 0, "family", value="x.y"), False),
            ("planned_and_made", _changed(catalog, "domain_coverage", "crypto", "planned_families", value=["crypto.btc_cycle_daily"]), False),
            ("homeless", _changed(catalog, "domain_coverage", "crypto", "implemented_families", value=[]), False),
            ("domain_of_unknown", _changed(catalog, "domain_coverage", "hk_equity", "implemented_families", value=["hk.z"]), False),
            ("sensitive", {**catalog, "auth": {"Authorization": 1}}, False),
        ]),
        "quality_report_validation": (B.validate_quality, [
            ("warn", report, True), ("pass", {**report, "quality_status": "pass"}, True), ("fail", {**report, "quality_status": "fail"}, False),
            ("unknown_status", {**report, "quality_status": "ok"}, False), ("negative", {**report, "raw_row_count": -1}, False), ("boolean", {**report, "dropped_row_count": True}, False),
            ("bad_digest", _changed(report, "input_csv", "sha256", value="B" * 64), False), ("blank_reason", {**report, "warning_reasons": [" "]}, False),
            ("no_columns", _changed(report, "selected_columns", drop=True), False), ("other_schema", {**report, "schema_version": "v0"}, False), ("sensitive", {**report, "session_cookie": ""}, False),
        ]),
        "audit_validation": (H.validate_audit, [
            ("runtime", audited, True), ("without_digests", {k: v for k, v in audited.items() if "registry_payload" not in k and not k.startswith("local_contract")}, True),
            ("some_digests", _changed(audited, "local_registry_payload_sha256", drop=True), False), ("digest_not_verified", {**audited, "local_contract_registry_verified": False}, False),
            ("not_ready", {**audited, "ready_for_consumption": False}, False), ("research_injected", {**audited, "consumption_mode": "offline_research"}, False),
            ("research", {**audited, "consumption_mode": "offline_research", "runtime_injection_allowed": False, "research_transform": "t", "research_as_of": "2025-01-01"}, True),
            ("no_bundle", {**audited, "bundle_id": " "}, False), ("csv_injected", {**audited, "research_csv_runtime_injection_allowed": True}, False), ("sensitive", {**audited, "signed_url": "x"}, False),
        ]),
        "plan_validation": (H.validate_plan, [
            ("plan", plan, True), ("not_allowed", {**plan, "injection_allowed": False}, False), ("other_target", {**plan, "target_path": "market_data.x"}, False),
            ("other_schema", {**plan, "schema_version": "v0"}, False), *((f"without_{p}", _changed(plan, p, drop=True), False) for p, _ in fields),
        ]),
        "plan_audit_match": (lambda x: H.plan_matches(x["plan"], x["audit"]), [
            ("same", {"plan": plan, "audit": audited}, True), ("more_in_audit", {"plan": plan, "audit": {**audited, "index_handoff_count": 3}}, True),
            *((f"other_{p}", {"plan": plan, "audit": {**audited, a: ["x"] if isinstance(audited[a], list) else "c" * 64}}, False) for p, a in fields),
        ]),
        "saved_audit_match": (lambda x: H.audits_agree(x["saved"], x["now"]), [
            ("same", {"saved": audited, "now": audited}, True), ("moved", {"saved": {**audited, "handoff_manifest_path": "elsewhere.json"}, "now": audited}, True),
            *((f"other_{k}", {"saved": {**audited, k: "other"}, "now": audited}, k in H._AUDIT_PATHS) for k in sorted(audited)),
        ]),
        "adapter_validation": (H.validate_adapter, [
            ("index", adapter, True), ("manifest", {**_changed(adapter, "signal_handoff_index", drop=True), "signal_handoff_manifest": "h.json", "signal_as_of": ""}, True),
            ("both", {**adapter, "signal_handoff_manifest": "h.json"}, False), ("neither", _changed(adapter, "signal_handoff_index", value=" "), False),
            ("no_day", _changed(adapter, "signal_as_of", drop=True), False), ("research", {**adapter, "signal_consumer": "research:x"}, False),
            ("plan_alone", {**adapter, "saved_runtime_plan_json": "p.json"}, False), ("plan_and_audit", {**adapter, "saved_runtime_plan_json": "p.json", "saved_consumption_audit_json": "a.json"}, True),
            ("flag_as_text", {**adapter, "require_all_known_families": "yes"}, False), ("no_strategy", {**adapter, "strategy": ""}, False), ("no_status", {**adapter, "accepted_freshness_statuses": []}, False),
        ]),
    }
    return kinds


def _judged_variants(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """(variant, documents, accepted): every order carries the variant its key says."""
        rule, variants = _variants()[kind]
        table = spark.createDataFrame([(i, name, json.dumps(document)) for i, (name, document, _) in enumerate(variants)], "i long, variant string, document string")
        # A rule's verdict is the document's alone, so orders are counted by variant before its text is fetched and judged.
        rows = X.read(spark, d, "orders").groupBy((F.col("o_orderkey") % len(variants)).alias("i")).agg(F.count(F.lit(1)).alias("documents"))
        found = judged(table.join(rows, "i").select("variant", "document", "documents"), "document", rule)
        return found.groupBy("variant").agg(F.sum("documents").alias("documents"), F.coalesce(F.sum(F.when(F.col("problem").isNull(), F.col("documents"))), F.lit(0)).alias("accepted"))

    return run


def _variant_sql(kind: str) -> str:
    names = [(i, name, ok) for i, (name, _, ok) in enumerate(_variants()[kind][1])]
    rows = ", ".join(f"({i}, '{name}', {str(ok).lower()})" for i, name, ok in names)
    return f"""WITH v(i, variant, ok) AS (VALUES {rows})
      SELECT variant, count(*) AS documents, count(*) FILTER (ok) AS accepted FROM orders JOIN v ON v.i = o_orderkey % {len(names)} GROUP BY variant"""


KINDS = ("registry_validation", "catalog_validation", "quality_report_validation", "audit_validation", "plan_validation", "plan_audit_match", "saved_audit_match", "adapter_validation")

QUERIES: dict[str, Query] = {
    "bundle_validation": bundle_validation,
    "bundle_for_consumer": bundle_for_consumer,
    "quality_documents": quality_documents,
    "publication_chains": publication_chains,
    "audit_documents": audit_documents,
    "plan_audit_documents": plan_audit_documents,
    "adapter_documents": adapter_documents,
    "family_matching": family_matching,
    "research_matching": research_matching,
    "governance_coverage": governance_coverage,
    "governance_ownership": governance_ownership,
    "governance_runtime": governance_runtime,
    "registry_fields": registry_fields,
    "catalog_fields": catalog_fields,
    **{kind: _judged_variants(kind) for kind in KINDS},
}


def _list(values: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_RECORDS = ", ".join(
    f"('{f['family']}', '{f['domain']}', '{f['transform']}', '{f['freshness_policy']}', {_list(f['symbols'])}, {_list(f['derived_indicator_fields'])}, {_list(f['compatible_profiles'])}, {_list(f['runtime_consumers']) if f['runtime_consumers'] else '[]::VARCHAR[]'})"
    for f in FAMILIES.values()
)
RECORDS = f"records(family, domain, transform, policy, symbols, fields, consumers, runtime) AS (VALUES {_RECORDS})"
_at = lambda values, column: f"{_list(values)}[{column} % {len(values)} + 1]"

SQL: dict[str, str] = {
    "bundle_validation": """SELECT o_orderkey, o_orderstatus <> 'P' AND o_totalprice >= 20000 AND o_orderpriority[1] NOT IN ('3', '4')
      AND month(o_orderdate) NOT IN (2, 3, 4, 5, 7, 8) AS accepted FROM orders""",
    "bundle_for_consumer": f"""SELECT o_orderkey, o_orderstatus <> 'P' AND o_orderpriority[1] <> '3' AND month(o_orderdate) >= {len(_REQUIRED)} AS accepted FROM orders""",
    "quality_documents": """SELECT o_orderkey, o_orderstatus <> 'P' AND o_orderpriority[1] <> '5' AND month(o_orderdate) > 8 AS accepted FROM orders""",
    "audit_documents": """SELECT o_orderkey, o_orderpriority[1] NOT IN ('1', '2') AND month(o_orderdate) <> 4
      AND CASE WHEN o_orderstatus = 'F' THEN month(o_orderdate) <> 3 ELSE month(o_orderdate) NOT IN (1, 2) END AS accepted FROM orders""",
    "plan_audit_documents": "SELECT o_orderkey, month(o_orderdate) = day(o_orderdate) AND o_orderpriority[1] <> '5' AS accepted FROM orders",
    "adapter_documents": """SELECT o_orderkey, o_orderstatus <> 'P' AND (o_orderstatus = 'F' OR month(o_orderdate) > 2) AND (month(o_orderdate) <> 5 OR o_orderpriority[1] = '1')
      AND month(o_orderdate) NOT IN (6, 7) AND o_orderpriority[1] <> '2' AS accepted FROM orders""",
    "publication_chains": """
      WITH o AS (SELECT o_orderkey, o_orderstatus, month(o_orderdate) AS m FROM orders),
      found AS (SELECT o_orderkey, CASE
          WHEN m = 7 THEN 'b:the link must be relative and stay below its document'
          WHEN m = 10 THEN 'b:the linked document doesn''t have the pinned hash'
          WHEN m = 12 THEN 'b:it differs from the linked document on bundle_id'
          WHEN o_orderstatus = 'P' AND m <> 8 THEN ''
          WHEN m = 8 AND o_orderstatus <> 'P' THEN 'b:bundle has a sensitive field'
          WHEN m = 9 THEN 'q:the quality report failed'
          WHEN m = 11 THEN 'q:the linked document doesn''t exist' END AS f, m, o_orderstatus FROM o),
      -- A bundle of another schema version has no rules of its own, so only what else is wrong counts.
      known AS (SELECT o_orderkey, CASE WHEN f <> '' OR f IS NULL THEN f WHEN m = 9 THEN 'q:the quality report failed' WHEN m = 11 THEN 'q:the linked document doesn''t exist' END AS f FROM found)
      SELECT 'p/' || o_orderkey || '.handoff.json' AS path, substr(f, 3) AS problem,
        CASE f[1] WHEN 'b' THEN 'bundle_manifest/bundle' WHEN 'q' THEN 'bundle_manifest/quality_report' END AS chain FROM known""",
    "family_matching": f"""WITH {RECORDS},
      b AS (SELECT {_at(_TRANSFORMS, 'l_partkey')} AS t, {_at(_POLICIES, 'l_suppkey')} AS p, replace(upper({_at(_SYMBOLS, 'l_orderkey')}), '.US', '') AS s,
        lower({_at(_FIELDS, 'l_linenumber')}) AS f, row_number() OVER () AS k FROM lineitem),
      m AS (SELECT k, coalesce(string_agg(family, ',' ORDER BY family), '') AS families
        FROM b LEFT JOIN records r ON r.transform = t AND r.policy = p AND list_contains(r.symbols, s) AND list_contains(r.fields, f) GROUP BY k)
      SELECT families, count(*) AS bundles FROM m GROUP BY families""",
    "research_matching": f"""WITH {RECORDS},
      e AS (SELECT {_at(_TRANSFORMS, 'l_partkey')} AS t, {_at(sorted(CONSUMERS), 'l_suppkey')} AS c, count(*) AS exports FROM lineitem GROUP BY ALL)
      SELECT t || '|' || c AS export, any_value(exports) AS exports, coalesce(string_agg(family, ',' ORDER BY family), '') AS families
      FROM e LEFT JOIN records r ON r.transform = t AND list_contains(r.consumers, c) GROUP BY t, c""",
    "governance_coverage": f"""WITH {NEED}, {RECORDS}
      SELECT r.family, n.consumer, coalesce(string_agg(n.symbol || '.' || n.field, ',' ORDER BY n.symbol || '.' || n.field)
        FILTER (NOT (list_contains(r.symbols, n.symbol) AND list_contains(r.fields, n.field))), '') AS missing
      FROM records r, need n GROUP BY r.family, n.consumer""",
    "governance_ownership": f"""WITH {NEED}, {HAVE}, {COVERED}, {RECORDS},
      lost AS (SELECT consumer, symbol || '.' || field AS f FROM need WHERE (consumer, symbol, field) NOT IN (SELECT (consumer, symbol, field) FROM covered)),
      own AS (SELECT c.consumer, coalesce(string_agg(family, ',' ORDER BY family), '') AS families
        FROM (SELECT DISTINCT consumer FROM need) c LEFT JOIN records r ON list_contains(r.consumers, c.consumer) GROUP BY c.consumer)
      SELECT own.consumer, CASE WHEN own.consumer LIKE 'research:%' THEN 'research' ELSE 'runtime' END AS kind, any_value(families) AS families,
        coalesce(string_agg(f, ',' ORDER BY f), '') AS missing, count(f) = 0 AS covered
      FROM own LEFT JOIN lost USING (consumer) GROUP BY own.consumer""",
    "governance_runtime": f"""WITH {NEED}, {RECORDS}, domains(domain) AS (VALUES {', '.join(f"('{x}')" for x in (*sorted(DOMAINS), 'all'))}),
      c AS (SELECT DISTINCT consumer FROM need WHERE consumer NOT LIKE 'research:%'),
      s AS (SELECT d.domain, c.consumer, coalesce(string_agg(family, ',' ORDER BY family), '') AS families
        FROM domains d CROSS JOIN c LEFT JOIN records r ON list_contains(r.runtime, c.consumer) AND d.domain IN ('all', r.domain) GROUP BY ALL)
      SELECT domain, consumer, families, families = '' AS bare, bool_and(families <> '') OVER (PARTITION BY domain) AS all_covered FROM s""",
    "registry_fields": f"WITH {NEED} SELECT consumer, symbol, ord::INTEGER AS position, field FROM need",
    "catalog_fields": f"WITH {RECORDS} SELECT family, domain, transform, policy, s.symbol, f.field FROM records, unnest(symbols) AS s(symbol), unnest(fields) AS f(field)",
    **{kind: _variant_sql(kind) for kind in KINDS},
}
