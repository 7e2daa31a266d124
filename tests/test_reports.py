"""Reports, prices and publications beyond the queries."""

import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_artifacts import refused, run, write_ramp

from sextant.artifacts import bundles as B
from sextant.artifacts import documents as D
from sextant.artifacts import governance as G
from sextant.functions.kernels import prefix_ranks
from sextant.operators import indicators as I
from sextant.operators import normalize as N
from sextant.plans import contracts as K
from sextant.sources import fixtures as X
from sextant.sources import klines

SF = "/root/testdata/sf0.001"
COLUMNS = {"fred.vixcls": {"date": "DATE", "value": "VIXCLS"}, "shiller.cape_monthly": {"date": "date", "value": "cape"}}


def sources(tmp_path, vix, cape):
    (tmp_path / "vix.csv").write_text(vix)
    (tmp_path / "cape.csv").write_text(cape)
    return {"fred.vixcls": str(tmp_path / "vix.csv"), "shiller.cape_monthly": str(tmp_path / "cape.csv")}


def test_public_report_counts_each_source(spark, tmp_path):
    vix = "DATE,VIXCLS\n2025-01-02,20\nbad,20\n2025-01-03,.\n2025-01-06,-1\n2025-01-06,10\n2025-01-06,11\n2025-01-09,12\n"
    paths = sources(tmp_path, vix, "date,cape\n2024-12-01,30\n")
    found = B.public_context_availability(spark, paths, COLUMNS, "2025-01-08")
    assert found["quality_status"] == "warn" and found["public_context_row_count"] == 2 and found["max_gap_days"] == 4
    first = found["input_sources"][0]
    counters = ("raw_row_count", "normalized_row_count", "filtered_after_as_of_count", "invalid_date_count", "null_value_count", "non_positive_value_count", "duplicate_date_count")
    assert [first[c] for c in counters] == [7, 2, 1, 1, 1, 1, 1]
    assert (first["first_date"], first["last_date"], first["latest_observation_lag_days"], first["max_allowed_lag_days"]) == ("2025-01-02", "2025-01-06", 2, 10)
    assert [w.split(":")[1] for w in first["warning_reasons"]] == ["invalid_dates_dropped", "null_values_dropped", "non_positive_values_dropped", "rows_after_as_of_filtered", "duplicate_dates_collapsed"]
    assert len(first) == 19 and first["source_columns"] == ["DATE", "VIXCLS"]


def test_public_report_fails_without_raising(spark, tmp_path, capsys):
    paths = sources(tmp_path, "DAY,VIXCLS\n2025-01-02,20\n", "date,cape\n")
    found = B.public_context_availability(spark, paths, COLUMNS, "2025-01-08")
    assert found["failure_reasons"] == ["fred.vixcls:missing_required_column:DATE", "shiller.cape_monthly:insufficient_positive_history"]
    assert found["input_sources"][0]["raw_row_count"] == 1 and found["public_context_row_count"] == 0
    args = ["--fred-vixcls-csv", paths["fred.vixcls"], "--shiller-cape-csv", paths["shiller.cape_monthly"], "--output-csv", tmp_path / "o.csv", "--quality-report", tmp_path / "q.json"]
    assert "missing_required_column" in refused(capsys, "export-us-equity-public-context-research-csv", *args)
    assert json.loads((tmp_path / "q.json").read_text())["quality_status"] == "fail"


def test_source_profiles_are_whole():
    profiles = [p for f in K.FAMILIES.values() for p in f["source_profiles"]]
    texts = ("source_id", "source_name", "provider_dataset", "history_frequency", "point_in_time_status", "publication_lag_policy", "research_use_policy")
    assert all(p[k].strip() for p in profiles for k in texts) and all("source_url" in p for p in profiles)
    summary = G.validate_catalog(G.catalog())
    assert summary["source_profile_coverage"]["us_equity.nasdaq_sp500_price_proxy_daily"]["source_ids"] == ["fred.nasdaq100", "fred.sp500"]
    short = G.profile_summary({"family": "f", "derived_indicator_fields": ["A"], "source_profiles": [dict.fromkeys(texts, "x") | {"produced_fields": ["a"], "max_allowed_lag_days": 3}]})
    assert short["covered_fields"] == ["a"] and short["profiles"][0]["max_allowed_lag_days"] == 3
    for bad in ([], [{**profiles[0], "produced_fields": ["zz"]}], [profiles[0]] * 2, [{**profiles[0], "max_allowed_lag_days": True}]):
        with pytest.raises(D.ValidationError):
            G.profile_summary({**K.FAMILIES["crypto.btc_cycle_daily"], "source_profiles": bad})


def test_latest_row_needs_the_tail_only(spark):
    rows = N.cycle(X.cycle_bars(spark, SF))
    assert I.latest(I.cycle_frame(rows)).collect() == I.cycle_latest(rows).collect()


def test_prefix_ranks_equal_counting():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 200, 1000):
        x = rng.integers(0, 30, n).astype(float)
        assert prefix_ranks(x).tolist() == [(x[: i + 1] <= v).sum() for i, v in enumerate(x)]


def test_percentiles_skip_nulls(spark):
    rows = spark.createDataFrame([("a", f"2020-01-0{i}", v) for i, v in enumerate([3.0, None, 1.0, 3.0, 2.0], 1)], "series string, date string, value double")
    found = I.expanding_percentile(rows).orderBy("date").collect()
    assert [r.percentile for r in found] == [1.0, None, 0.5, 1.0, 0.5]


def test_sample_counts_are_floats(spark):
    frame = I.rotation_frame(N.technical(X.daily_bars(spark, SF)).select("symbol", "date", "close"))
    assert all(t == "double" for c, t in frame.dtypes if c.endswith("_sample_count"))


def test_uploads_report_failures(tmp_path):
    done = []
    klines.upload(tmp_path, "gs://bucket/prefix/", run=lambda c, **_: done.append(c) or subprocess.CompletedProcess(c, 0))
    assert done == [["gsutil", "-m", "rsync", "-r", str(tmp_path), "gs://bucket/prefix"]]
    with pytest.raises(OSError, match="denied"):
        klines.upload(tmp_path, "p", run=lambda c, **_: subprocess.CompletedProcess(c, 1, stdout="", stderr="denied"))


def test_cycle_handoff_end_to_end(spark, tmp_path, capsys):
    made = run(capsys, "publish-cycle-handoff", "--work-dir", tmp_path / "w", "--input-csv", write_ramp(tmp_path / "btc.csv"))
    index = D.read(made["platform_handoff_index_path"])
    assert made["platform_handoff_index_path"] == str(tmp_path / "w" / "platform_handoffs" / "index.json") and len(index["handoffs"]) == 1
    assert index["handoffs"][0]["as_of"] == made["as_of"] and not made["uploaded"]
    audited = run(capsys, "audit-signal-consumption", "--consumer", "us_equity:ibit_smart_dca", "--platform-handoff-index", made["platform_handoff_index_path"])
    assert audited["ready_for_runtime_injection"]
    assert "upload-prefix" in refused(capsys, "publish-cycle-handoff", "--work-dir", tmp_path / "w2", "--input-csv", tmp_path / "btc.csv", "--execute")


def test_newest_takes_the_first_of_equal_entries(spark):
    rows = [("2025-01-01", "fresh", ["a"], 0), ("2025-01-02", "FRESH", ["a"], 2), ("2025-01-02", "fresh", ["a"], 1), ("2025-01-03", "stale", ["a"], 3), ("2025-01-03", "fresh", ["b"], 4)]
    entries = spark.createDataFrame(rows, "as_of string, freshness_status string, compatible_profiles array<string>, position long")
    assert [r.position for r in K.newest(entries, None, "a").collect()] == [1]
    assert K.newest(entries, "2020-01-01", None).count() == 0 and K.newest(entries.where(F.lit(False)), None, None).count() == 0


def test_many_series_in_many_files(spark, tmp_path):
    from sextant.sources import files

    (tmp_path / "a.csv").write_text("day,sym,px\n2025-01-01,A,1\n2025-01-01,A,2\n2025-01-02,B,5\n")
    (tmp_path / "b.csv").write_text("day,sym,px\n2025-01-02,A,3\nbad,A,4\n")
    names = {"date": "day", "symbol": "sym", "close": "px"}
    rows = N.cycle(files.read_many(spark, str(tmp_path / "*.csv"), names)).orderBy("symbol", "date").collect()
    assert [(r.symbol, str(r.date), r.close) for r in rows] == [("A", "2025-01-01", 2.0), ("A", "2025-01-02", 3.0), ("B", "2025-01-02", 5.0)]
    with pytest.raises(ValueError, match="no column"):
        files.read_many(spark, str(tmp_path / "*.csv"), {"date": "when"})
    assert files.csv_header(spark, (tmp_path / "a.csv").as_uri()) == ["day", "sym", "px"]
    uri = files.read_csv(spark, (tmp_path / "a.csv").as_uri(), {"date": "day", "close": "px"}, ("date",))
    assert uri.count() == 3
