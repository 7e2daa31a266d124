"""One dispatcher for all commands: ``python -m sextant.cli.main COMMAND ...``.

Every command prints sorted JSON and returns 0; a handled error goes to stderr and returns 2.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import functions as F

from ..artifacts import bundles as B
from ..artifacts import documents as D
from ..artifacts import governance as G
from ..artifacts import handoff as H
from ..functions import columns as C
from ..operators import indicators as I
from ..operators import normalize as N
from ..sources import files as S
from ..sources import klines as K

COLUMNS = ("date", "close", "high", "low", "volume")


def _spark():
    from pyspark.sql import SparkSession

    from ..session import local_session

    return SparkSession.getActiveSession() or local_session(4, "2g", 4)


def _columns(a: argparse.Namespace) -> dict[str, str]:
    return {c: getattr(a, f"{c}_column") for c in COLUMNS}


def _raw(a: argparse.Namespace, path: str, symbol: str):
    return S.read_csv(_spark(), path, _columns(a), ("date", "close")).withColumn("symbol", F.lit(symbol))


def _gates(a: argparse.Namespace) -> H.Gates:
    return H.Gates(a.require_all_known_families, a.require_all_known_consumers, a.require_runtime_consumer_coverage)


def _published(a: argparse.Namespace, document: dict, quality: str | None) -> dict[str, Any]:
    found = B.write_bundle(a.output_dir, document, quality)
    if a.publication_index:
        B.upsert_index(a.publication_index, found["manifest"], accepted=(a.freshness_status,))
        found["publication_index"] = str(a.publication_index)
    return found | {"bundle_id": document["bundle_id"], "as_of": document["as_of"]}


def _quality(a: argparse.Namespace, path: str, name: str, least: int, gap: int) -> tuple[str, dict]:
    report = B.quality_report(_spark(), path, _columns(a), a.as_of, least, gap)
    target = Path(a.output_dir) / name
    D.write(target, report)
    return str(target), report


def _provenance(a: argparse.Namespace) -> dict[str, Any]:
    return {
        "as_of": a.as_of, "generated_at": a.generated_at, "source_version": a.source_version, "code_commit": a.code_commit, "provider": a.provider,
        "status": a.freshness_status, "license_scope": a.license_scope, "provider_dataset": a.provider_dataset,
    }


def build_cycle(a: argparse.Namespace) -> dict[str, Any]:
    found = B.cycle_payloads(_raw(a, a.input_csv, a.symbol), a.as_of)
    quality, _ = _quality(a, a.input_csv, "quality_report.json", 200, 1)
    document = B.family_bundle("crypto.btc_cycle_daily", found, raw_sha256=S.sha256_file(a.input_csv), **_provenance(a))
    return _published(a, document, quality)


def build_technical(a: argparse.Namespace) -> dict[str, Any]:
    """A bundle of one symbol's CSV; or with --symbol-column of all symbols, or those listed in --symbol, in the CSVs that
    --input-csv names (a file, folder or pattern at any path that Spark reads)."""
    if a.symbol_column:
        raw, sha = _many(a)
        quality = None  # a bundle pins one report, so each symbol's lies beside it
        for symbol, report in B.quality_reports(raw, {"path": a.input_csv, "sha256": sha}, _columns(a), a.as_of, a.min_history, a.max_allowed_gap_days).items():
            D.write(Path(a.output_dir) / f"{symbol.lower()}_quality_report.json", report)
    else:
        raw, sha = _raw(a, a.input_csv, a.symbol), S.sha256_file(a.input_csv)
        quality, _ = _quality(a, a.input_csv, "quality_report.json", a.min_history, a.max_allowed_gap_days)
    found = B.technical_payloads(raw, a.as_of, a.min_history)
    document = B.family_bundle(
        "us_equity.technical_daily", found, raw_sha256=sha, policy=a.freshness_policy, profiles=a.compatible_profile or None,
        bundle_id_prefix=a.bundle_id_prefix, **_provenance(a),
    )
    document["provenance"]["transform"] = a.transform
    document["domain"] = a.domain
    return _published(a, document, quality)


def _many(a: argparse.Namespace):
    """(rows, combined hash of the files) of many symbols."""
    spark = _spark()
    raw = S.read_many(spark, a.input_csv, {**_columns(a), "symbol": a.symbol_column})
    wanted = [s.upper() for s in _split(a.symbol)]
    raw = raw.withColumn("symbol", F.upper(F.trim("symbol"))).where(F.col("symbol").isNotNull() & (F.col("symbol") != ""))
    raw = raw if wanted in ([], ["*"]) else raw.where(F.col("symbol").isin(wanted))
    files = S.sha256_files(spark, a.input_csv)
    return raw, files.agg(C.combined_hash(F.element_at(F.split("path", "/"), -1), F.col("sha256"))).first()[0]


def build_rotation(a: argparse.Namespace) -> dict[str, Any]:
    raw = _raw(a, a.soxl_csv, "SOXL").unionByName(_raw(a, a.soxx_csv, "SOXX"), allowMissingColumns=True)
    params = I.RotationParams(
        a.trend_ma_window, a.dynamic_rsi_quantile_window, a.dynamic_rsi_quantile, a.dynamic_rsi_floor, a.dynamic_volatility_delever_window,
        a.dynamic_volatility_delever_quantile_window, a.dynamic_volatility_delever_quantile, a.dynamic_volatility_delever_min_periods,
        a.dynamic_volatility_delever_floor, a.dynamic_volatility_delever_cap, a.min_history,
    )
    found = B.rotation_payloads(raw, a.as_of, params)
    hashes = {"SOXL": S.sha256_file(a.soxl_csv), "SOXX": S.sha256_file(a.soxx_csv)}
    for s, path in (("soxl", a.soxl_csv), ("soxx", a.soxx_csv)):
        _quality(a, path, f"{s}_quality_report.json", params.look_back, a.max_allowed_gap_days)
    # The bundle's hash covers both files, so no single report can be pinned to it.
    both = _combined_sha256(hashes)
    document = B.family_bundle("us_equity.semiconductor_rotation_daily", {s: found[s] for s in ("SOXL", "SOXX")}, raw_sha256=both, policy=a.freshness_policy, profiles=a.compatible_profile or None, **_provenance(a))
    return _published(a, document, None)


def _combined_sha256(hashes: dict[str, str]) -> str:
    import hashlib

    return hashlib.sha256("".join(f"{s}:{h}\n" for s, h in sorted(hashes.items())).encode()).hexdigest()


def _exported(a: argparse.Namespace, frame, **manifest: Any) -> dict[str, Any]:
    rows = frame.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    if (n := rows.count()) < a.min_history:
        raise ValueError(f"{n} rows, fewer than the {a.min_history} needed")
    S.write_csv(rows, a.output_csv)
    target = a.manifest_path or f"{a.output_csv}.manifest.json"
    return B.write_export(target, a.output_csv, source_version=a.source_version, as_of=a.as_of, min_history=a.min_history, **manifest) | {"manifest_path": str(target)}


def export_cycle(a: argparse.Namespace) -> dict[str, Any]:
    frame = I.cycle_frame(N.cycle(_raw(a, a.input_csv, "BTC-USD"), a.as_of), a.min_history).drop("symbol")
    a.min_history, least = 1, a.min_history
    return _exported(a, frame, input_csv=a.input_csv, artifact_type="btc_cycle_research_csv", transform="crypto.btc.ahr999.v1", parameters={"min_history": least})


def export_context(a: argparse.Namespace) -> dict[str, Any]:
    names = {
        "date": a.date_column, "cape_percentile": a.cape_percentile_column, "vix_percentile": a.vix_percentile_column, "breadth_above_sma200_pct": a.breadth_column,
        "provider_timestamp": a.provider_timestamp_column, "breadth_universe_snapshot_id": a.breadth_universe_snapshot_column,
        "breadth_universe_as_of": a.breadth_universe_as_of_column,
    } | {c: c for c in _split(a.passthrough_columns)}
    raw = S.read_csv(_spark(), a.input_csv, names, ("date", *N.CONTEXT_FIELDS)).withColumn("series", F.lit("c"))
    if a.quality_report:
        from ..operators.quality import context_report

        report = {"schema_version": D.CONTEXT_REPORT, "input_csv": D.file_record(a.input_csv), "as_of": a.as_of}
        report |= B._report(context_report(raw, a.as_of, a.require_point_in_time_metadata, a.min_history, a.max_allowed_gap_days))
        D.write(a.quality_report, report)
        if report["quality_status"] == "fail" and a.require_point_in_time_metadata:
            raise ValueError(f"the availability report failed: {', '.join(report['failure_reasons'])}")
    frame = N.context(raw, a.as_of, tuple(_split(a.passthrough_columns))).drop("series")
    return _exported(a, frame, input_csv=a.input_csv, artifact_type="us_equity_context_research_csv", transform="us_equity.nasdaq_sp500.context.v1", quality_report=a.quality_report)


def _split(text: str) -> list[str]:
    return [c.strip() for c in text.split(",") if c.strip()]


def _metric(path: str, date: str, value: str, as_of: str | None):
    raw = S.read_csv(_spark(), path, {"date": date, "value": value}, ("date", "value")).withColumn("series", F.lit("x"))
    rows = N.metric(raw, "value", as_of)
    if rows.isEmpty():
        raise ValueError(f"{path} has no usable rows")
    return rows


def export_public_context(a: argparse.Namespace) -> dict[str, Any]:
    paths = {"fred.vixcls": a.fred_vixcls_csv, "shiller.cape_monthly": a.shiller_cape_csv}
    lags = {"fred.vixcls": a.max_fred_vix_lag_days, "shiller.cape_monthly": a.max_shiller_cape_lag_days}
    if a.quality_report:
        columns = {
            "fred.vixcls": {"date": a.fred_date_column, "value": a.fred_vix_column},
            "shiller.cape_monthly": {"date": a.shiller_date_column, "value": a.shiller_cape_column},
        }
        report = B.public_context_availability(_spark(), paths, columns, a.as_of, lags, a.min_history, a.max_allowed_gap_days)
        D.write(a.quality_report, report)
        if report["quality_status"] == "fail":
            raise ValueError(f"the availability report failed: {', '.join(report['failure_reasons'])}")
    vix = _metric(a.fred_vixcls_csv, a.fred_date_column, a.fred_vix_column, a.as_of)
    cape = _metric(a.shiller_cape_csv, a.shiller_date_column, a.shiller_cape_column, a.as_of)
    frame = I.public_context(vix, cape, F.lit(a.provider_timestamp) if a.provider_timestamp else None).drop("series")
    sources = [D.file_record(p, source_id=s) for s, p in paths.items()]
    return _exported(a, frame, input_csv=a.fred_vixcls_csv, artifact_type="us_equity_public_context_research_csv", transform="us_equity.nasdaq_sp500.context.v1", sources=sources, parameters={"max_allowed_lag_days": lags}, quality_report=a.quality_report)


def export_price_proxy(a: argparse.Namespace) -> dict[str, Any]:
    first = _metric(a.fred_nasdaq100_csv, a.nasdaq100_date_column, a.nasdaq100_value_column, a.as_of)
    second = _metric(a.fred_sp500_csv, a.sp500_date_column, a.sp500_value_column, a.as_of)
    frame = I.price_proxy(first, second, stamp=F.lit(a.provider_timestamp) if a.provider_timestamp else None).drop("series")
    sources = [D.file_record(a.fred_nasdaq100_csv, source_id="fred.nasdaq100"), D.file_record(a.fred_sp500_csv, source_id="fred.sp500")]
    return _exported(a, frame, input_csv=a.fred_nasdaq100_csv, artifact_type="us_equity_price_proxy_research_csv", transform="us_equity.nasdaq_sp500.price_proxy.v1", sources=sources)


def contracts(a: argparse.Namespace) -> dict[str, Any]:
    if a.validate_json:
        return G.validate_registry(D.read(a.validate_json), a.require_all_known_consumers)
    if a.validate_manifest:
        return G.validate_pinned("registry", a.validate_manifest, a.require_all_known_consumers)
    document = G.registry(a.consumer or None)
    if a.output_dir:
        return G.write_pinned("registry", a.output_dir, document)
    if a.output_json:
        D.write(a.output_json, document)
        return D.with_file(a.output_json, G.validate_registry(document))
    return document


def families(a: argparse.Namespace) -> dict[str, Any]:
    if a.validate_json:
        found = G.validate_catalog(D.read(a.validate_json), a.require_all_known_families)
    elif a.validate_manifest:
        found = G.validate_pinned("catalog", a.validate_manifest, a.require_all_known_families)
    else:
        document = G.catalog(a.family or None, a.domain or None)
        if a.output_dir:
            found = G.write_pinned("catalog", a.output_dir, document)
        elif a.output_json:
            D.write(a.output_json, document)
            found = D.with_file(a.output_json, G.validate_catalog(document))
        else:
            found = document | {"all_runtime_consumers_covered": G.runtime_coverage(document["families"])["all_runtime_consumers_covered"]}
    D.check(found["all_runtime_consumers_covered"] or not a.require_runtime_consumer_coverage, "not all runtime consumers are covered")
    return found


def handoffs(a: argparse.Namespace) -> dict[str, Any]:
    gates = _gates(a)
    if a.validate_manifest:
        return H.validate_handoff(a.validate_manifest, a.consumer, gates)
    if a.validate_index:
        return H.validate_handoff_index(a.validate_index, a.consumer, a.as_of, gates)
    if a.upsert_index:
        return H.upsert_handoff(a.upsert_index, a.handoff_manifest[0], gates=gates)
    if a.output_index:
        return H.write_handoff_index(a.output_index, a.handoff_manifest, gates=gates)
    return H.write_handoff(a.output_manifest, a.signal_bundle_manifest, a.source_family_catalog_manifest, a.consumer_contract_registry_manifest, a.consumer, gates)


def research_handoffs(a: argparse.Namespace) -> dict[str, Any]:
    if a.validate_manifest:
        return H.validate_handoff(a.validate_manifest, a.consumer, _gates(a))
    return H.write_handoff(a.output_manifest, a.research_export_manifest, a.source_family_catalog_manifest, a.consumer_contract_registry_manifest, a.consumer, _gates(a), True)


def audits(a: argparse.Namespace) -> dict[str, Any]:
    modes: dict[str, Callable[[Any], dict]] = {
        "validate_json": lambda p: H.validate_audit(D.read(p)),
        "validate_runtime_adapter_config_json": lambda p: H.validate_adapter(D.read(p)),
        "validate_runtime_adapter_config_set_json": lambda p: H.validate_adapter_set(p),
        "validate_runtime_adapter_deployment_json": H.validate_deployment,
        "validate_runtime_adapter_deployment_set_json": lambda p: H.validate_adapter_set(p, deployed=True),
        "validate_runtime_plan_json": lambda p: H.validate_plan(D.read(p)),
        "validate_runtime_plan_with_audit": lambda p: H.validate_plan_matches_audit(p, a.audit_json),
    }
    chosen = [m for m in modes if getattr(a, m)]
    D.check(len(chosen) <= 1, "give one validation at a time")
    if chosen:
        return modes[chosen[0]](getattr(a, chosen[0]))
    D.check(a.consumer, "an audit needs --consumer")
    found = H.audit(a.consumer, handoff=a.platform_handoff_manifest, index=a.platform_handoff_index, research=a.research_handoff_manifest, as_of=a.as_of, gates=_gates(a))
    if a.output_json:
        D.write(a.output_json, found)
    if a.output_runtime_plan_json or a.runtime_injection_plan:
        plan = H.injection_plan(found)
        if a.output_runtime_plan_json:
            D.write(a.output_runtime_plan_json, plan)
        if a.runtime_injection_plan:
            return plan
    return found


def publish(a: argparse.Namespace) -> dict[str, Any]:
    gates = H.Gates(not a.allow_partial_source_catalog, not a.allow_partial_consumer_registry, not a.allow_partial_runtime_coverage, tuple(a.accepted_freshness_status or [D.FRESH]))
    return H.publish(a.publication_dir, a.signal_bundle_manifest, a.consumer, index=a.index_path, as_of=a.lookup_as_of, strategy=a.strategy, gates=gates)


def publish_cycle(a: argparse.Namespace) -> dict[str, Any]:
    """Prices (given or fetched), the day, the cycle bundle, its publication and, if asked for, the upload."""
    work = Path(a.work_dir).resolve()
    source, provider = a.input_csv or str(work / "inputs" / "btc_daily.csv"), "local_csv"
    if not a.input_csv:
        _, provider = K.fetch_csv(_spark(), source)
    as_of = S.resolve_as_of(source, a.as_of, K.default_as_of())
    root = work / "platform_handoffs"
    folder = root / as_of
    made = main_json([
        "build-btc-cycle-bundle", "--input-csv", source, "--output-dir", str(folder / "bundle"), "--as-of", as_of, "--generated-at", f"{as_of}T00:15:00Z",
        "--provider", provider, "--provider-dataset", "btcusdt_daily_klines", "--source-version", a.source_version, "--code-commit", a.code_commit,
    ])
    found = main_json([
        "publish-platform-signal-handoff", "--publication-dir", str(folder), "--signal-bundle-manifest", str(made["manifest"]), "--consumer", a.consumer,
        "--strategy", a.strategy, "--index-path", str(root / "index.json"), "--lookup-as-of", as_of,
    ])
    if a.execute:
        D.check(a.upload_prefix, "an upload needs --upload-prefix")
        K.upload(root, a.upload_prefix)
    return {"as_of": as_of, "provider": provider, "bundle_manifest": made["manifest"], "uploaded": bool(a.execute)} | {k: found[k] for k in ("publication_dir", "platform_handoff_index_path")}


def check_bundle(a: argparse.Namespace) -> dict[str, Any]:
    if a.index:
        return B.validate_index(a.path, a.consumer, a.as_of, a.bundle_id)
    return B.validate_manifest(a.path, a.consumer)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sextant", description="Market signal artifacts")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *needed: str, **optional: Any) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--pretty", action="store_true")
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n, default in optional.items():
            option = "--" + n.replace("_", "-")
            if default is False:
                p.add_argument(option, action="store_true")
            elif default == []:
                p.add_argument(option, action="append", default=[])
            else:
                p.add_argument(option, default=default, type=type(default) if isinstance(default, (int, float)) else str)
        return p

    csv_columns = {f"{c}_column": c for c in COLUMNS}
    gates = dict(require_all_known_families=False, require_all_known_consumers=False, require_runtime_consumer_coverage=False)
    made = dict(provider="local_csv", license_scope="internal_runtime", source_version="0.1.0", code_commit="0" * 40, freshness_status=D.FRESH, publication_index=None)
    out = ("output-dir", "as-of", "generated-at")
    linked = dict(source_family_catalog_manifest=None, consumer_contract_registry_manifest=None, output_manifest=None, validate_manifest=None, consumer=None)
    export = dict(manifest_path=None, as_of=None, source_version="0.1.0")

    command("build-btc-cycle-bundle", build_cycle, "input-csv", *out, symbol="BTC-USD", provider_dataset="btc_usd_daily_ohlcv", **made, **csv_columns)
    command(
        "build-daily-technical-bundle", build_technical, "input-csv", "symbol", *out, symbol_column=None, domain="us_equity", bundle_id_prefix="us_equity.technical.daily",
        transform="technical.daily_ohlcv.v1", provider_dataset="daily_ohlcv", freshness_policy="daily_close_t_plus_1", min_history=252, max_allowed_gap_days=5,
        compatible_profile=[], **made, **csv_columns,
    )
    r = I.RotationParams()
    p = command(
        "build-semiconductor-rotation-bundle", build_rotation, "soxl-csv", "soxx-csv", *out, provider_dataset="us_equity_semiconductor_daily_ohlcv",
        freshness_policy="us_equity_daily_close_t_plus_1", trend_ma_window=r.trend_window, dynamic_rsi_quantile_window=r.rsi_window, dynamic_rsi_quantile=r.rsi_quantile,
        dynamic_rsi_floor=r.rsi_floor, dynamic_volatility_delever_window=r.volatility_window, dynamic_volatility_delever_quantile_window=r.volatility_quantile_window,
        dynamic_volatility_delever_quantile=r.volatility_quantile, dynamic_volatility_delever_min_periods=r.volatility_min_periods,
        dynamic_volatility_delever_floor=r.volatility_floor, dynamic_volatility_delever_cap=r.volatility_cap, max_allowed_gap_days=5, compatible_profile=[], **made, **csv_columns,
    )
    p.add_argument("--min-history", type=int, default=None)
    command("export-btc-cycle-research-csv", export_cycle, "input-csv", "output-csv", min_history=200, **export, **csv_columns)
    command(
        "export-us-equity-context-research-csv", export_context, "input-csv", "output-csv", min_history=1, max_allowed_gap_days=7, quality_report=None, date_column="date",
        cape_percentile_column="cape_percentile", vix_percentile_column="vix_percentile", breadth_column="breadth_above_sma200_pct", provider_timestamp_column="provider_timestamp",
        breadth_universe_snapshot_column="breadth_universe_snapshot_id", breadth_universe_as_of_column="breadth_universe_as_of", require_point_in_time_metadata=False,
        passthrough_columns="QQQ,SPY", **export,
    )
    command(
        "export-us-equity-public-context-research-csv", export_public_context, "fred-vixcls-csv", "shiller-cape-csv", "output-csv", min_history=1, max_allowed_gap_days=7,
        max_fred_vix_lag_days=10, max_shiller_cape_lag_days=120, quality_report=None, fred_date_column="DATE", fred_vix_column="VIXCLS", shiller_date_column="date",
        shiller_cape_column="cape", provider_timestamp=None, **export,
    )
    command(
        "export-us-equity-price-proxy-research-csv", export_price_proxy, "fred-nasdaq100-csv", "fred-sp500-csv", "output-csv", min_history=1, nasdaq100_date_column="DATE",
        nasdaq100_value_column="NASDAQ100", sp500_date_column="DATE", sp500_value_column="SP500", provider_timestamp=None, **export,
    )
    command("list-signal-consumer-contracts", contracts, consumer=[], output_json=None, output_dir=None, validate_json=None, validate_manifest=None, require_all_known_consumers=False)
    command("list-signal-ownership-matrix", lambda a: G.ownership_matrix(a.consumer or None), consumer=[])
    command(
        "list-signal-source-families", families, family=[], domain=[], validate_json=None, validate_manifest=None, output_json=None, output_dir=None,
        require_all_known_families=False, require_runtime_consumer_coverage=False,
    )
    command("build-platform-handoff", handoffs, signal_bundle_manifest=None, handoff_manifest=[], output_index=None, upsert_index=None, validate_index=None, as_of=None, **linked, **gates)
    command("build-research-handoff", research_handoffs, research_export_manifest=None, **linked, **gates)
    command(
        "audit-signal-consumption", audits, platform_handoff_manifest=None, platform_handoff_index=None, research_handoff_manifest=None, consumer=None, output_json=None,
        validate_json=None, validate_runtime_adapter_config_json=None, validate_runtime_adapter_config_set_json=[], validate_runtime_adapter_deployment_json=None,
        validate_runtime_adapter_deployment_set_json=[], output_runtime_plan_json=None, validate_runtime_plan_json=None, validate_runtime_plan_with_audit=None, audit_json=None,
        as_of=None, runtime_injection_plan=False, **gates,
    )
    command(
        "publish-platform-signal-handoff", publish, "publication-dir", "signal-bundle-manifest", "consumer", index_path=None, lookup_as_of=None, strategy=None,
        accepted_freshness_status=[], allow_partial_source_catalog=False, allow_partial_consumer_registry=False, allow_partial_runtime_coverage=False,
    )
    command(
        "publish-cycle-handoff", publish_cycle, work_dir="data/output", as_of=None, input_csv=None, upload_prefix=None, execute=False, source_version="0.1.0",
        code_commit="0" * 40, consumer="us_equity:ibit_smart_dca", strategy="ibit_smart_dca",
    )
    command("validate-quality-report", lambda a: D.with_file(a.path, B.validate_quality(D.read(a.path), not a.allow_fail_status)), allow_fail_status=False).add_argument("path")
    command("validate-research-export", lambda a: B.validate_export(a.path, a.expected_artifact_type, a.expected_transform), expected_artifact_type=None, expected_transform=None).add_argument("path")
    command("validate-signal-bundle", check_bundle, index=False, as_of=None, bundle_id=None, consumer=None).add_argument("path")
    return top


def main_json(argv: list[str]) -> dict[str, Any]:
    """What a command finds, for commands that run others."""
    a = parser().parse_args(argv)
    return D.json_safe(a.run(a))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        found = D.json_safe(a.run(a))
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(found, sort_keys=True, indent=2 if a.pretty else None))
    return 0


if __name__ == "__main__":
    sys.exit(main())
