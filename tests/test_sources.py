"""CSV sources: positions, required columns, as-of dates, hashes."""

import hashlib

import pytest

from sextant import api

CSV = "day,px,high,vol\n2025-01-03,3,4,1\n2025-01-01,1,2,1\n2025-01-01,1.5,2,1\n2025-01-02,.,2,1\n2025-01-04,0,2,1\n"


@pytest.fixture
def path(tmp_path):
    (tmp_path / "x.csv").write_text(CSV)
    return str(tmp_path / "x.csv")


def test_load(spark, path):
    rows = api.load_ohlcv(spark, path, "X", {"date": "day", "close": "px", "volume": "vol"}, "2025-01-03").orderBy("date").collect()
    assert [(str(r.date), r.close, r.high, r.low) for r in rows] == [("2025-01-01", 1.5, 2.0, 1.5), ("2025-01-03", 3.0, 4.0, 3.0)]
    with pytest.raises(ValueError, match="no column"):
        api.load_ohlcv(spark, path, "X")
    with pytest.raises(ValueError, match="no usable"):
        api.load_ohlcv(spark, path, "X", {"date": "day", "close": "px"}, "2024-01-01")


def test_hashes(spark, path):
    want = hashlib.sha256(CSV.encode()).hexdigest()
    assert api.sha256_file(path) == want
    assert [(r.sha256, r["size"]) for r in api.sha256_files(spark, path).collect()] == [(want, len(CSV))]
    assert api.csv_provenance(path, "2025-01-03").provider_timestamp == "2025-01-03T00:00:00Z"
    with pytest.raises(ValueError, match="provider must"):
        api.csv_provenance(path, "2025-01-03", provider=" ")


def test_resolve_as_of(tmp_path):
    (tmp_path / "y.csv").write_text("date,close\n2025-01-01,1\n2025-01-02,2\n")
    resolve = lambda requested: api.resolve_as_of(str(tmp_path / "y.csv"), requested, "2025-01-01")
    assert (resolve(None), resolve("2025-01-02"), resolve("2025-02-01")) == ("2025-01-01", "2025-01-02", "2025-01-02")
    (tmp_path / "z.csv").write_text("date,close\n")
    with pytest.raises(ValueError, match="no dates"):
        api.resolve_as_of(str(tmp_path / "z.csv"), None, "2025-01-01")
