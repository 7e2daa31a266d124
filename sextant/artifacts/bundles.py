"""Signal bundles, their manifests, publication indexes, quality reports and research exports."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import normalize as N
from ..operators import quality as Q
from ..plans.contracts import FAMILIES, required_fields
from ..sources.files import csv_shape, read_csv, sha256_file
from . import documents as D
from .commits import commit

MIN_CONTRACT = "derived_indicators+portfolio_snapshot"


# ---- payloads from frames


def payloads(latest: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> dict[str, dict[str, Any]]:
    """symbol to fields of the latest rows: one row per symbol reaches the driver."""
    rows = latest.collect()
    return {r[keys[0]]: D.json_safe({k: v for k, v in r.asDict().items() if k not in (*keys, "date", "series")}) for r in rows}


def _enough(rows: DataFrame, least: int, what: str) -> DataFrame:
    short = rows.groupBy("symbol").count().where(F.col("count") < least).collect()
    if short or rows.isEmpty():
        raise ValueError(f"{what} needs {least} rows of each symbol; too few of: {', '.join(r.symbol for r in short) or 'all'}")
    return rows


def cycle_payloads(raw: DataFrame, as_of: str | None, min_history: int = 200) -> dict[str, dict]:
    rows = _enough(N.cycle(raw, as_of), min_history, "the cycle family")
    return payloads(I.cycle_latest(rows, min_history))


def technical_payloads(raw: DataFrame, as_of: str | None, min_history: int = 252) -> dict[str, dict]:
    rows = _enough(N.technical(raw, as_of), min_history, "the technical family")
    return payloads(I.latest(I.technical_frame(rows, min_history)))


def rotation_payloads(raw: DataFrame, as_of: str | None, params: I.RotationParams = I.RotationParams(), lead: str = "SOXL") -> dict[str, dict]:
    """The traded symbol carries price and trend only; an unknown dynamic threshold is left out."""
    rows = _enough(N.cycle(raw.drop("high"), as_of), params.look_back, "the rotation family")
    found = payloads(I.rotation_latest(rows, params))
    kept = {s: {k: v for k, v in p.items() if s != lead or k in ("price", "ma_trend")} for s, p in found.items()}
    return {s: {k: v for k, v in p.items() if v is not None or not k.endswith("_dynamic_threshold")} for s, p in kept.items()}


# ---- bundles


def bundle(
    *, domain: str, bundle_id: str, as_of: str, generated_at: str, indicators: Mapping[str, Mapping[str, Any]], profiles: Iterable[str],
    freshness: Mapping[str, Any], provenance: Mapping[str, Any], min_contract: str = MIN_CONTRACT,
) -> dict[str, Any]:
    """The bundle document; every symbol needs a payload that isn't empty."""
    if empty := [s for s, p in indicators.items() if not p] or ([] if indicators else ["any symbol"]):
        raise ValueError(f"no indicators for {', '.join(empty)}")
    document = {
        "schema_version": D.BUNDLE,
        "bundle_id": bundle_id,
        "bundle_type": D.DERIVED,
        "domain": domain,
        "consumer_contract": {"canonical_input": D.DERIVED, "compatible_profiles": list(profiles), "min_strategy_contract": min_contract},
        "as_of": as_of,
        "generated_at": generated_at,
        "symbols": [s.strip().upper() for s in indicators],
        D.DERIVED: {s.strip().upper(): dict(p) for s, p in indicators.items()},
        "freshness": dict(freshness),
        "provenance": dict(provenance),
    }
    D.required(document, "bundle_id", "domain", "as_of", "generated_at", owner="bundle")
    return document


def family_bundle(
    family: str, indicators: Mapping[str, Mapping[str, Any]], *, as_of: str, generated_at: str, raw_sha256: str, source_repo: str = "sextant",
    source_version: str = "0.1.0", code_commit: str = "0" * 40, provider: str = "local_csv", provider_timestamp: str | None = None,
    status: str = D.FRESH, policy: str | None = None, max_age_hours: int = 36, license_scope: str = "internal_runtime",
    generated_by: str = "sextant.local_csv", profiles: Iterable[str] | None = None, bundle_id_prefix: str | None = None, provider_dataset: str | None = None,
) -> dict[str, Any]:
    """A bundle of a catalogued family: ids, transform, policy and profiles come from its record."""
    f = FAMILIES[family]
    return bundle(
        domain=f["domain"],
        bundle_id=f"{bundle_id_prefix or f['bundle_id_prefix']}.{as_of}",
        as_of=as_of,
        generated_at=generated_at,
        indicators=indicators,
        profiles=f["compatible_profiles"] if profiles is None else profiles,
        freshness={"policy": policy or f["freshness_policy"], "max_age_hours": int(max_age_hours), "provider_timestamp": provider_timestamp or f"{as_of}T00:00:00Z", "status": status},
        provenance={
            "source_repo": source_repo, "source_version": source_version, "code_commit": code_commit, "provider": provider,
            "provider_dataset": provider_dataset or f["provider_dataset"], "raw_artifact_sha256": raw_sha256, "transform": f["transform"],
            "license_scope": license_scope, "generated_by": generated_by,
        },
    )


def validate_bundle(document: Mapping[str, Any], accepted: Iterable[str] = (D.FRESH,), canonical: str = D.DERIVED) -> None:
    D.schema(document, D.BUNDLE)
    D.required(document, "bundle_id", "as_of", "generated_at", "domain", owner="bundle")
    contract = document.get("consumer_contract") or {}
    D.check(contract.get("canonical_input") == canonical, f"canonical_input must be {canonical}")
    D.texts(contract.get("compatible_profiles"), "compatible_profiles")
    freshness = document.get("freshness") or {}
    D.fresh_enough(freshness.get("status"), accepted)
    D.required(freshness, "provider_timestamp", owner="freshness")
    D.required(document.get("provenance") or {}, *D.PROVENANCE, owner="provenance")
    found = document.get(canonical)
    D.check(isinstance(found, Mapping) and found and all(isinstance(p, Mapping) and p for p in found.values()), f"{canonical} must hold a payload per symbol")
    lost = set(D.texts(document.get("symbols"), "symbols")) - set(found)
    D.check(not lost, f"no payload for {sorted(lost)}")
    D.no_sensitive_keys(document, "bundle")


def _normal(symbol: str) -> str:
    return symbol.strip().upper().removesuffix(".US")


def validate_for_consumer(document: Mapping[str, Any], consumer: str) -> None:
    """The bundle names the consumer and has all fields it requires, in any case."""
    D.check(consumer in document["consumer_contract"]["compatible_profiles"], f"the bundle isn't compatible with {consumer}")
    have = {_normal(s): {k.lower() for k in p} for s, p in document[D.DERIVED].items()}
    missing = [f"{s}.{f}" for s, fields in required_fields(consumer).items() for f in fields if f.lower() not in have.get(_normal(s), set())]
    D.check(not missing, f"the bundle lacks {', '.join(missing)}")


def bundle_summary(document: Mapping[str, Any]) -> dict[str, Any]:
    fields = {s: sorted(p) for s, p in document[D.DERIVED].items()}
    return {
        "bundle_id": document["bundle_id"],
        "as_of": document["as_of"],
        "canonical_input": document["consumer_contract"]["canonical_input"],
        "compatible_profiles": list(document["consumer_contract"]["compatible_profiles"]),
        "freshness_status": document["freshness"]["status"],
        "freshness_policy": document["freshness"].get("policy", ""),
        "transform": document["provenance"]["transform"],
        "symbols": list(document["symbols"]),
        "indicator_fields_by_symbol": fields,
        "indicator_field_counts": {s: len(f) for s, f in fields.items()},
    }


# ---- manifests and indexes


def write_bundle(directory: str | Path, document: Mapping[str, Any], quality_report: str | Path | None = None) -> dict[str, Any]:
    """Bundle first, manifest that pins it, index that pins the manifest; then all are read again."""
    root = Path(directory)
    contract, freshness = document["consumer_contract"], document["freshness"]
    manifest = {
        "schema_version": D.MANIFEST,
        "bundle_path": "signal_bundle.json",
        "bundle_sha256": D.write(root / "signal_bundle.json", document),
        "bundle_id": document["bundle_id"],
        "as_of": document["as_of"],
        "canonical_input": contract["canonical_input"],
        "compatible_profiles": list(contract["compatible_profiles"]),
        "bundle_schema_version": document["schema_version"],
        "freshness_status": freshness.get("status", ""),
    } | ({} if quality_report is None else D.pins(root, quality_report=quality_report))
    D.write(root / "manifest.json", manifest)
    write_index(root / "index.json", [root / "manifest.json"], accepted=(freshness.get("status", ""),))
    return {"bundle": str(root / "signal_bundle.json"), "manifest": str(root / "manifest.json"), "index": str(root / "index.json")}


def _entry(index_root: Path, manifest_path: str | Path) -> dict[str, Any]:
    m = D.read(manifest_path)
    copied = {k: m[k] for k in ("bundle_id", "as_of", "canonical_input", "compatible_profiles", "bundle_schema_version", "freshness_status") if m.get(k)}
    return {"manifest_path": D.inside(index_root, manifest_path), "manifest_sha256": sha256_file(manifest_path)} | copied


def write_index(path: str | Path, manifests: Iterable[str | Path], generated_at: str | None = None, accepted: Iterable[str] = (D.FRESH,), keep: Iterable[dict] = ()) -> dict[str, Any]:
    """Index of manifests below its folder, sorted; every entry is validated once written."""
    path = Path(path)
    index = _index([*keep, *(_entry(path.parent, m) for m in manifests)], generated_at)
    commit(path, lambda _: index)
    for e in index["bundles"]:
        _validated_entry(path, e, accepted)
    return index


def _index(entries: list[dict[str, Any]], generated_at: str | None) -> dict[str, Any]:
    D.check(entries, "an index needs an entry")
    entries = sorted(entries, key=lambda e: (e["as_of"], e["bundle_id"], e["manifest_path"]))
    return {"schema_version": D.INDEX, "generated_at": generated_at or f"{max(e['as_of'] for e in entries)}T00:15:00Z", "bundles": entries}


def upsert_index(path: str | Path, manifest: str | Path, generated_at: str | None = None, accepted: Iterable[str] = (D.FRESH,)) -> dict[str, Any]:
    """Put a manifest's entry in place of the one of the same bundle, date and input. Writers may do so at
    once (``commits``); the entry is validated before it is seen."""
    identity = lambda e: (e["bundle_id"], e["as_of"], e["canonical_input"])
    path = Path(path)
    new = _entry(path.parent, manifest)
    _validated_entry(path, new, accepted)

    def put(index: dict[str, Any] | None) -> dict[str, Any]:
        kept = [e for e in (index or {}).get("bundles", []) if identity(e) != identity(new)]
        return _index([*kept, new], generated_at)

    return commit(path, put)[1]


def validate_manifest(path: str | Path, consumer: str | None = None, accepted: Iterable[str] = (D.FRESH,)) -> dict[str, Any]:
    """Manifest, bundle and quality report hold together (and serve the consumer); a summary."""
    m = D.read(path)
    D.schema(m, D.MANIFEST)
    D.required(m, "bundle_id", "as_of", "canonical_input", owner="manifest")
    D.check(bool(m.get("quality_report_path")) == bool(m.get("quality_report_sha256")), "quality report path and hash go together")
    root = Path(path).parent
    document = D.read(D.pinned(root, m, "bundle"))
    validate_bundle(document, accepted)
    flat = {
        **document, "canonical_input": document["consumer_contract"]["canonical_input"], "compatible_profiles": document["consumer_contract"]["compatible_profiles"],
        "freshness_status": document["freshness"]["status"], "bundle_schema_version": document["schema_version"],
    }
    D.same(m, flat, ("bundle_id", "as_of", "canonical_input", "compatible_profiles", "freshness_status", "bundle_schema_version"), "manifest and bundle")
    if m.get("quality_report_path"):
        report = D.read(D.pinned(root, m, "quality_report"))
        validate_quality(report)
        D.check(report["input_csv"]["sha256"] == document["provenance"]["raw_artifact_sha256"], "the quality report is of another input")
    if consumer:
        validate_for_consumer(document, consumer)
    return D.with_file(path, bundle_summary(document) | ({"consumer": consumer} if consumer else {}))


def _validated_entry(path: str | Path, entry: dict, accepted: Iterable[str], consumer: str | None = None) -> dict[str, Any]:
    manifest_path = D.pinned(Path(path).parent, entry, "manifest")
    summary = validate_manifest(manifest_path, consumer, accepted)
    D.same(entry, summary, ("bundle_id", "as_of", "canonical_input", "freshness_status", "compatible_profiles"), "index entry and manifest")
    return summary


def validate_index(path: str | Path, consumer: str | None = None, as_of: str | None = None, bundle_id: str | None = None, accepted: Iterable[str] = (D.FRESH,)) -> dict[str, Any]:
    """The newest entry that is fresh, not after ``as_of`` and made for the consumer, validated."""
    index = D.read(path)
    D.schema(index, D.INDEX)
    accepted = tuple(accepted)

    def fits(e: dict) -> bool:
        return (
            str(e.get("freshness_status", "")).lower() in {a.lower() for a in accepted}
            and (bundle_id is None or e.get("bundle_id") == bundle_id)
            and (as_of is None or str(e.get("as_of")) <= as_of)
            and (consumer is None or consumer in e.get("compatible_profiles", ()))
        )

    entry = D.newest(index.get("bundles") or [], fits, ("as_of",), "bundle of the index")
    return _validated_entry(path, entry, accepted, consumer) | {"index_path": str(path), "index_bundle_count": len(index["bundles"])}


# ---- quality reports


def _report(found: DataFrame) -> dict[str, Any]:
    row = D.json_safe(found.first().asDict())
    return {k: ("" if v is None and k.endswith("_date") else v) for k, v in row.items() if k not in ("series", "symbol")}


def quality_report(
    spark: SparkSession, path: str, columns: Mapping[str, str] | None = None, as_of: str | None = None, min_history: int = 200, max_gap: int = 1
) -> dict[str, Any]:
    """Report on one OHLCV CSV; a missing column makes it fail rather than raise."""
    names = {c: c for c in ("date", "close", "high", "low", "volume")} | dict(columns or {})
    with open(path, newline="", encoding="utf-8") as f:
        header = next(csv.reader(f), [])
    base = {
        "schema_version": D.QUALITY, "artifact_type": "local_ohlcv_quality_report", "input_csv": D.file_record(path), "selected_columns": names,
        "source_columns": header, "as_of": as_of, "min_history_rows": int(min_history), "max_allowed_gap_days": int(max_gap),
    }
    counters = ("raw_row_count", "normalized_row_count", "filtered_after_as_of_count", "dropped_row_count", "invalid_date_count", "null_close_count", "non_positive_close_count", "duplicate_date_count", "max_gap_days", "gap_count_above_threshold")
    if lost := [names[c] for c in ("date", "close") if names[c] not in header]:
        return base | dict.fromkeys(counters, 0) | {"first_date": "", "last_date": "", "quality_status": "fail", "failure_reasons": [f"missing_column:{c}" for c in lost], "warning_reasons": []}
    raw = read_csv(spark, path, names).withColumn("series", F.lit("x"))
    if raw.isEmpty():
        failures = ["no_usable_rows", "insufficient_history_rows"][: 1 + (min_history > 0)]
        return base | dict.fromkeys(counters, 0) | {"first_date": "", "last_date": "", "quality_status": "fail", "failure_reasons": failures, "warning_reasons": []}
    return base | _report(Q.ohlcv_report(raw, as_of, min_history, max_gap))


def quality_reports(raw: DataFrame, source: Mapping[str, Any], columns: Mapping[str, str], as_of: str | None = None, min_history: int = 200, max_gap: int = 1) -> dict[str, dict[str, Any]]:
    """A report for each symbol of rows of many, all from one aggregation; ``source`` records their files."""
    base = {
        "schema_version": D.QUALITY, "artifact_type": "local_ohlcv_quality_report", "input_csv": dict(source), "selected_columns": dict(columns),
        "source_columns": sorted(set(columns.values())), "as_of": as_of, "min_history_rows": int(min_history), "max_allowed_gap_days": int(max_gap),
    }
    found = Q.ohlcv_report(raw.withColumnRenamed("symbol", "series"), as_of, min_history, max_gap)
    reports = {}
    for row in found.collect():  # a row a symbol
        facts = D.json_safe({k: v for k, v in row.asDict().items() if k != "series"})
        reports[row["series"]] = base | {k: "" if v is None and k.endswith("_date") else v for k, v in facts.items()}
    return reports


def context_availability(spark: SparkSession, path: str, as_of: str | None = None, strict: bool = False, min_history: int = 1, max_gap: int = 7) -> dict[str, Any]:
    found = Q.context_report(read_csv(spark, path).withColumn("series", F.lit("x")), as_of, strict, min_history, max_gap)
    return {"schema_version": D.CONTEXT_REPORT, "input_csv": D.file_record(path), "as_of": as_of} | _report(found)


_SOURCE_COUNTERS = (
    "raw_row_count", "normalized_row_count", "filtered_after_as_of_count", "invalid_date_count", "null_value_count", "non_positive_value_count", "duplicate_date_count",
)
_SOURCE_WARNINGS = (
    ("invalid_date_count", "invalid_dates_dropped"), ("null_value_count", "null_values_dropped"), ("non_positive_value_count", "non_positive_values_dropped"),
    ("filtered_after_as_of_count", "rows_after_as_of_filtered"), ("duplicate_date_count", "duplicate_dates_collapsed"),
)


def source_report(spark: SparkSession, source: str, path: str, columns: Mapping[str, str], as_of: str | None, max_lag: int | None) -> dict[str, Any]:
    """Audit of one public source (date and value columns of a CSV); a missing column is a failure of the report."""
    with open(path, newline="", encoding="utf-8") as f:
        header = next(csv.reader(f), [])
    lost = [c for c in columns.values() if c not in header]
    found = dict.fromkeys(_SOURCE_COUNTERS, 0) | {"first_date": None, "last_date": None}
    raw = read_csv(spark, path, {c: c for c in header} if lost else dict(columns)).withColumn("series", F.lit(source))
    if lost:
        found["raw_row_count"] = raw.count()
    elif row := Q.source_audit(raw, as_of).first():
        found = row.asDict()
    failures = [f"{source}:missing_required_column:{c}" for c in lost]
    lag = None
    if not lost and not found["normalized_row_count"]:
        failures.append(f"{source}:insufficient_positive_history")
    elif not lost and as_of:
        lag = max(0, (_date(as_of) - found["last_date"]).days)
        failures += [f"{source}:latest_observation_stale"] if max_lag is not None and lag > max_lag else []
    return D.file_record(path, source_id=source) | {k: found[k] for k in _SOURCE_COUNTERS} | {
        "selected_columns": dict(columns), "source_columns": header, "first_date": str(found["first_date"] or ""), "last_date": str(found["last_date"] or ""),
        "latest_observation_lag_days": lag, "max_allowed_lag_days": max_lag, "failure_reasons": failures,
        "warning_reasons": [f"{source}:{text}" for c, text in _SOURCE_WARNINGS if found[c] and not lost],
    }


def public_context_availability(
    spark: SparkSession, paths: Mapping[str, str], columns: Mapping[str, Mapping[str, str]], as_of: str | None = None, max_lags: Mapping[str, int] | None = None,
    min_history: int = 1, max_gap: int = 7,
) -> dict[str, Any]:
    """Report on the volatility and the valuation source and on what they make together. Sources that
    lack a column, are empty or stale fail it; the merged series is only built if none does."""
    lags = {"fred.vixcls": 10, "shiller.cape_monthly": 120} | dict(max_lags or {})
    sources = [source_report(spark, s, paths[s], columns[s], as_of, lags[s]) for s in lags]
    failures = [r for s in sources for r in s["failure_reasons"]]
    warnings = [r for s in sources for r in s["warning_reasons"]]
    rows, days = 0, None
    if not failures:
        read = lambda s: N.metric(read_csv(spark, paths[s], dict(columns[s])).withColumn("series", F.lit("x")), "value", as_of)
        merged = I.public_context(*(read(s) for s in lags))
        span = merged.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b")).first()
        days = Q.gap_stats(merged, ("series",), max_gap).first()
        rows = span.n
        failures += ["insufficient_public_context_history"] if rows < min_history else []
        warnings += ["public_context_date_gaps_above_threshold"] if days and days.gap_count_above_threshold else []
    failures, warnings = list(dict.fromkeys(failures)), list(dict.fromkeys(warnings))
    return {
        "schema_version": D.PUBLIC_CONTEXT_REPORT, "artifact_type": "us_equity_public_context_availability_report",
        "quality_status": "fail" if failures else "warn" if warnings else "pass", "failure_reasons": failures, "warning_reasons": warnings,
        "as_of": None if as_of is None else as_of[:10], "min_history_rows": min_history, "max_allowed_gap_days": max_gap,
        "max_fred_vix_lag_days": lags["fred.vixcls"], "max_shiller_cape_lag_days": lags["shiller.cape_monthly"], "input_sources": sources,
        "public_context_row_count": rows, "first_date": str(span.a or "") if rows else "", "last_date": str(span.b or "") if rows else "",
        "max_gap_days": days.max_gap_days if days else 0, "gap_count_above_threshold": days.gap_count_above_threshold if days else 0,
    }


def _date(text: str):
    from datetime import date

    return date.fromisoformat(text[:10])


def validate_quality(report: Mapping[str, Any], reject_fail: bool = True) -> dict[str, Any]:
    """Shape of an OHLCV quality report; counters are whole numbers, not booleans."""
    D.schema(report, D.QUALITY)
    D.required(report, "artifact_type", "quality_status", "input_csv", "selected_columns", "source_columns", owner="quality report")
    counters = [k for k in report if k.endswith("_count") or k in ("min_history_rows", "max_allowed_gap_days", "max_gap_days")]
    for k in ("raw_row_count", "normalized_row_count", "dropped_row_count", *counters):
        v = report.get(k)
        D.check(isinstance(v, int) and not isinstance(v, bool) and (v >= 0 or k == "duplicate_date_count"), f"{k} must be a count")
    for k in ("failure_reasons", "warning_reasons"):
        D.texts(report.get(k), k, may_be_empty=True)
    D.digest_text(report["input_csv"].get("sha256"), "input_csv.sha256")
    D.check(report["quality_status"] in ("pass", "warn", "fail"), "quality_status must be pass, warn or fail")
    D.check(report["quality_status"] != "fail" or not reject_fail, f"the quality report failed: {', '.join(report['failure_reasons'])}")
    D.no_sensitive_keys(report, "quality_report")
    return {"quality_status": report["quality_status"], "normalized_row_count": report["normalized_row_count"]}


# ---- research exports


def write_export(
    manifest_path: str | Path, frame_csv: str | Path, *, input_csv: str | Path, artifact_type: str, transform: str, source_version: str, as_of: str | None,
    min_history: int, sources: Iterable[Mapping[str, Any]] | None = None, parameters: Mapping[str, Any] | None = None, quality_report: str | Path | None = None,
) -> dict[str, Any]:
    """Manifest of a written research CSV, with its shape and hashes."""
    columns, rows, first, last = csv_shape(str(frame_csv))
    manifest = {
        "schema_version": D.RESEARCH_EXPORT, "artifact_type": artifact_type, "transform": transform, "source_version": source_version, "as_of": as_of,
        "min_history": int(min_history), "row_count": rows, "first_date": first, "last_date": last, "columns": columns,
        "input_csv": D.file_record(input_csv), "output_csv": D.file_record(frame_csv),
    }
    manifest |= {} if sources is None else {"input_sources": [dict(s) for s in sources]}
    manifest |= {} if parameters is None else {"transform_parameters": dict(parameters)}
    manifest |= {} if quality_report is None else {"quality_report": D.file_record(quality_report)}
    D.write(manifest_path, manifest)
    return manifest


def validate_export(path: str | Path, artifact_type: str | None = None, transform: str | None = None) -> dict[str, Any]:
    m = D.read(path)
    D.schema(m, D.RESEARCH_EXPORT)
    D.required(m, "artifact_type", "transform", "source_version", "as_of", "columns", "row_count", owner="research export")
    D.check(artifact_type in (None, m["artifact_type"]), f"artifact_type must be {artifact_type}")
    D.check(transform in (None, m["transform"]), f"transform must be {transform}")
    found = {}
    for name in ("input_csv", "output_csv", *(["quality_report"] if "quality_report" in m else [])):
        record = m[name]
        tries = [Path(record["path"])] if Path(record["path"]).is_absolute() else [Path(path).parent / record["path"], Path(record["path"])]
        file = next((t for t in tries if t.is_file()), None)
        D.check(file is not None, f"{record['path']} doesn't exist")
        D.check(sha256_file(file) == record["sha256"] and file.stat().st_size == record["size_bytes"], f"{name} has changed")
        found[name] = file
    shape = dict(zip(("columns", "row_count", "first_date", "last_date"), csv_shape(str(found["output_csv"])), strict=True))
    D.same(m, shape, shape, "manifest and CSV")
    D.no_sensitive_keys(m, "research_export")
    return D.with_file(path, {k: m[k] for k in ("artifact_type", "transform", "as_of", "row_count")} | {
        "output_csv_sha256": m["output_csv"]["sha256"], "quality_report_sha256": m.get("quality_report", {}).get("sha256", ""),
    })


