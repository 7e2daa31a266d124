"""Commands and documents from CSV files to a published, audited handoff, and what must be refused."""

import json
from datetime import date, timedelta
from pathlib import Path

import pytest

from sextant.artifacts import bundles as B
from sextant.artifacts import documents as D
from sextant.artifacts import governance as G
from sextant.artifacts import handoff as H
from sextant.cli.main import main

AS_OF = "2026-01-31"
CONSUMER = "us_equity:ibit_smart_dca"


def write_ramp(path: Path, rows: int = 220, base: float = 50000.0, end: str = AS_OF) -> Path:
    first = date.fromisoformat(end) - timedelta(days=rows - 1)
    lines = ["date,open,high,low,close,volume"]
    lines += [f"{first + timedelta(days=i)},{base + i - 25},{base + i + 100},{base + i - 100},{base + i},10" for i in range(rows)]
    path.write_text("\n".join(lines) + "\n")
    return path


def run(capsys, *argv) -> dict:
    code = main([str(a) for a in argv])
    out = capsys.readouterr()
    assert code == 0, out.err
    return json.loads(out.out)


def refused(capsys, *argv) -> str:
    assert main([str(a) for a in argv]) == 2
    return capsys.readouterr().err


@pytest.fixture
def published(spark, tmp_path, capsys):
    csv = write_ramp(tmp_path / "btc.csv")
    built = run(capsys, "build-btc-cycle-bundle", "--input-csv", csv, "--output-dir", tmp_path / "pub/bundle", "--as-of", AS_OF, "--generated-at", f"{AS_OF}T00:15:00Z", "--publication-index", tmp_path / "pub/index.json")
    made = run(capsys, "publish-platform-signal-handoff", "--publication-dir", tmp_path / "pub", "--signal-bundle-manifest", built["manifest"], "--consumer", CONSUMER)
    return tmp_path / "pub", built, made


def test_publication_chain(published, capsys):
    root, built, made = published
    assert made["runtime_plan"]["target_path"] == "market_data.derived_indicators"
    assert made["handoff"]["matched_source_families"] == ["crypto.btc_cycle_daily"]
    assert made["runtime_adapter_deployment"]["current_audit_verified"]
    assert run(capsys, "validate-signal-bundle", root / "index.json", "--index", "--consumer", CONSUMER)["as_of"] == AS_OF
    assert run(capsys, "audit-signal-consumption", "--validate-runtime-adapter-deployment-json", made["runtime_adapter_config_path"])["consumer"] == CONSUMER
    assert run(capsys, "audit-signal-consumption", "--validate-runtime-plan-with-audit", made["runtime_plan_path"], "--audit-json", made["consumption_audit_path"])["matched_field_count"] == 19
    assert "wrong" not in refused(capsys, "audit-signal-consumption", "--validate-runtime-adapter-deployment-set-json", made["runtime_adapter_config_path"], "--validate-runtime-adapter-deployment-set-json", made["runtime_adapter_config_path"])


def test_upsert_keeps_one_entry(published):
    root, built, made = published
    H.upsert_handoff(made["platform_handoff_index_path"], made["platform_handoff_manifest_path"])
    assert len(D.read(made["platform_handoff_index_path"])["handoffs"]) == 1
    B.upsert_index(root / "index.json", built["manifest"])
    assert len(D.read(root / "index.json")["bundles"]) == 1


def test_tampering_is_found(published, capsys):
    root, built, made = published
    text = Path(built["bundle"]).read_text()
    Path(built["bundle"]).write_text(text.replace('"rsi14": ', '"rsi14": 1'))
    assert "pinned hash" in refused(capsys, "validate-signal-bundle", built["manifest"])
    assert "pinned hash" in refused(capsys, "audit-signal-consumption", "--consumer", CONSUMER, "--platform-handoff-index", made["platform_handoff_index_path"])


def test_newer_incompatible_bundle_is_skipped(published, tmp_path):
    root, built, _ = published
    document = D.read(built["bundle"])
    newer = document | {"as_of": "2026-02-01", "bundle_id": "x.2026-02-01", "consumer_contract": document["consumer_contract"] | {"compatible_profiles": ["research:other"]}}
    other = B.write_bundle(root / "newer", newer)
    B.upsert_index(root / "index.json", other["manifest"])
    assert B.validate_index(root / "index.json", CONSUMER)["as_of"] == AS_OF
    assert B.validate_index(root / "index.json")["as_of"] == "2026-02-01"


def test_bundle_rules(published):
    document = D.read(published[1]["bundle"])
    for change, part in (
        ({"freshness": document["freshness"] | {"status": "stale"}}, "freshness"),
        ({"provenance": document["provenance"] | {"api_key_id": "x"}}, "sensitive"),
        ({"provenance": document["provenance"] | {"transform": " "}}, "transform"),
        ({"symbols": ["ETH"]}, "payload"),
    ):
        with pytest.raises(D.ValidationError, match=part):
            B.validate_bundle(document | change)
    B.validate_bundle(document | {"freshness": document["freshness"] | {"status": "last_valid"}}, ("last_valid",))
    with pytest.raises(D.ValidationError, match="lacks"):
        B.validate_for_consumer(document | {D.DERIVED: {"BTC-USD": {"close": 1}}}, CONSUMER)


def test_links_stay_inside(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b.json").write_text("{}")
    for bad in ("../b.json", str(tmp_path / "b.json"), "", None):
        with pytest.raises(D.ValidationError):
            D.linked(tmp_path / "a", bad)


def test_public_context_golden_rows(spark, tmp_path, capsys):
    (tmp_path / "vix.csv").write_text("DATE,VIXCLS\n2025-01-02,20\n2025-01-03,.\n2025-01-06,10\n2025-01-07,30\n2025-01-08,25\n")
    (tmp_path / "cape.csv").write_text("date,cape\n2024-12-01,30\n2025-01-05,25\n2025-02-01,40\n")
    args = ["--fred-vixcls-csv", tmp_path / "vix.csv", "--shiller-cape-csv", tmp_path / "cape.csv", "--output-csv", tmp_path / "out.csv", "--as-of", "2025-01-07"]
    made = run(capsys, "export-us-equity-public-context-research-csv", *args, "--quality-report", tmp_path / "q.json")
    lines = (tmp_path / "out.csv").read_text().split()
    assert lines[0] == "date,cape_percentile,vix_percentile,provider_timestamp"
    assert lines[1:] == ["2025-01-02,1.0,1.0,2025-01-02T00:00:00Z", "2025-01-06,0.5,0.5,2025-01-06T00:00:00Z", "2025-01-07,0.5,1.0,2025-01-07T00:00:00Z"]
    assert run(capsys, "validate-research-export", made["manifest_path"])["row_count"] == 3
    G.write_pinned("registry", tmp_path, G.registry())
    G.write_pinned("catalog", tmp_path, G.catalog())
    consumer = "research:nasdaq_sp500_cape_vix_external_context_precomputed"
    names = ("--source-family-catalog-manifest", tmp_path / "signal_source_families.manifest.json", "--consumer-contract-registry-manifest", tmp_path / "market_signal_consumers.manifest.json")
    run(capsys, "build-research-handoff", "--research-export-manifest", made["manifest_path"], *names, "--consumer", consumer, "--output-manifest", tmp_path / "h.json")
    found = run(capsys, "audit-signal-consumption", "--consumer", consumer, "--research-handoff-manifest", tmp_path / "h.json")
    assert found["runtime_injection_allowed"] is False and found["research_as_of"] == "2025-01-07"
    (tmp_path / "out.csv").write_text("date\n")
    assert "changed" in refused(capsys, "validate-research-export", made["manifest_path"])
    assert "stale" in refused(capsys, "export-us-equity-public-context-research-csv", *args[:-1], "2026-06-19", "--quality-report", tmp_path / "q.json")


def test_price_proxy_and_cycle_exports(spark, tmp_path, capsys):
    (tmp_path / "ndx.csv").write_text("DATE,NASDAQ100\n2025-01-02,100\nbad,5\n2025-01-03,101\n2025-01-06,103\n2025-01-07,104\n")
    (tmp_path / "spx.csv").write_text("DATE,SP500\n2025-01-02,50\n2025-01-03,51\n2025-01-06,53\n2025-01-08,54\n2025-01-09,.\n")
    run(capsys, "export-us-equity-price-proxy-research-csv", "--fred-nasdaq100-csv", tmp_path / "ndx.csv", "--fred-sp500-csv", tmp_path / "spx.csv", "--output-csv", tmp_path / "p.csv")
    assert [x.split(",")[1:3] for x in (tmp_path / "p.csv").read_text().split()[1:]] == [["100.0", "50.0"], ["101.0", "51.0"], ["103.0", "53.0"]]
    csv = write_ramp(tmp_path / "btc.csv", 205)
    assert run(capsys, "export-btc-cycle-research-csv", "--input-csv", csv, "--output-csv", tmp_path / "c.csv")["row_count"] == 6


def test_context_export_and_strict_gate(spark, tmp_path, capsys):
    rows = "".join(f"2025-01-0{i + 1},{100 + i},{50 + i},0.9,0.85,0.35\n" for i in range(5))
    (tmp_path / "ctx.csv").write_text("date,QQQ,SPY,cape_percentile,vix_percentile,breadth_above_sma200_pct\n" + rows)
    args = ["export-us-equity-context-research-csv", "--input-csv", tmp_path / "ctx.csv", "--output-csv", tmp_path / "o.csv", "--as-of", "2025-01-04", "--quality-report", tmp_path / "r.json"]
    assert run(capsys, *args)["row_count"] == 4
    assert D.read(tmp_path / "r.json")["quality_status"] == "warn"
    assert "missing_provider_timestamp_column" in refused(capsys, *args, "--require-point-in-time-metadata")


def test_technical_and_rotation_bundles(spark, tmp_path, capsys):
    out = ("--as-of", AS_OF, "--generated-at", f"{AS_OF}T00:15:00Z")
    csv = write_ramp(tmp_path / "qqq.csv", 270, 100.0)
    built = run(capsys, "build-daily-technical-bundle", "--input-csv", csv, "--symbol", "QQQ", "--output-dir", tmp_path / "t", *out)
    assert len(D.read(built["bundle"])[D.DERIVED]["QQQ"]) == 16
    files = [write_ramp(tmp_path / f"{s}.csv", 430, b) for s, b in (("soxl", 25.0), ("soxx", 400.0))]
    built = run(capsys, "build-semiconductor-rotation-bundle", "--soxl-csv", files[0], "--soxx-csv", files[1], "--output-dir", tmp_path / "r", *out)
    found = D.read(built["bundle"])[D.DERIVED]
    assert set(found["SOXL"]) == {"price", "ma_trend"} and len(found["SOXX"]) == 26
    assert "rows" in refused(capsys, "build-daily-technical-bundle", "--input-csv", write_ramp(tmp_path / "s.csv", 100), "--symbol", "SPY", "--output-dir", tmp_path / "x", *out)


def test_quality_report_files(spark, tmp_path, capsys):
    csv = write_ramp(tmp_path / "a.csv", 10)
    D.write(tmp_path / "q.json", B.quality_report(spark, str(csv), as_of=AS_OF))
    assert "failed" in refused(capsys, "validate-quality-report", tmp_path / "q.json")
    assert run(capsys, "validate-quality-report", tmp_path / "q.json", "--allow-fail-status")["quality_status"] == "fail"
    assert B.quality_report(spark, str(csv), {"close": "px"})["failure_reasons"] == ["missing_column:px"]


def test_listings_and_governance(capsys, tmp_path):
    matrix = run(capsys, "list-signal-ownership-matrix")
    assert matrix["consumer_count"] == 10 and matrix["all_runtime_consumers_cover_required_fields"]
    assert len(run(capsys, "list-signal-source-families", "--require-runtime-consumer-coverage")["families"]) == 6
    assert "not all runtime" in refused(capsys, "list-signal-source-families", "--family", "crypto.btc_cycle_daily", "--require-runtime-consumer-coverage")
    assert len(run(capsys, "list-signal-consumer-contracts", "--output-dir", tmp_path)["consumers"]) == 10
    assert run(capsys, "list-signal-consumer-contracts", "--validate-manifest", tmp_path / "market_signal_consumers.manifest.json")["local_contract_registry_verified"]
    assert "unknown consumer" in refused(capsys, "list-signal-consumer-contracts", "--consumer", "nobody")
    drifted = G.registry()
    drifted["contracts"][0]["required_indicator_fields_by_symbol"]["BTC-USD"] = ["close"]
    with pytest.raises(D.ValidationError, match="drifted"):
        G.validate_registry(drifted)
    with pytest.raises(D.ValidationError, match="lacks"):
        G.validate_catalog(G.catalog(["us_equity.technical_daily"]), complete=True)
