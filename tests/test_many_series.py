"""Commands over many symbols in many files, and CSV files written and read by many tasks."""

import json

import pytest
from pyspark.sql import functions as F

from sextant.artifacts import bundles as B
from sextant.artifacts import documents as D
from sextant.cli.main import main
from sextant.sources import files


@pytest.fixture
def small_splits(spark):
    """Blocks of 1 KB, so that each file is read by many tasks."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "1024")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _lines(symbol, n, step):
    days = [f"{2024 + i // 360}-{i // 30 % 12 + 1:02}-{min(i % 30 + 1, 28):02}" for i in range(n)]
    return [f"{symbol},{d},{100 + i * step},{102 + i * step},{99 + i * step},10" for i, d in enumerate(days)]


def _written(folder):
    folder.mkdir()
    header = "sym,date,close,high,low,volume"
    qqq, spy, short = _lines("QQQ", 330, 0.5), _lines(" spy", 330, 0.25), _lines("NEW", 5, 1)
    (folder / "a.csv").write_text("\n".join([header, *qqq[:200], *spy]) + "\n")
    (folder / "b.csv").write_text("\n".join([header, *qqq[200:]]) + "\n")
    (folder / "c.csv").write_text("\n".join([header, *short]) + "\n")
    (folder / "one.txt").write_text("\n".join([header, *qqq]) + "\n")
    return folder


def test_a_bundle_of_many_symbols_from_a_folder(spark, tmp_path, small_splits, capsys):
    folder = _written(tmp_path / "in")
    args = ["build-daily-technical-bundle", "--as-of", "2025-01-01", "--generated-at", "2025-01-01T00:15:00Z", "--symbol-column", "sym", "--symbol", "qqq, SPY"]
    assert main([*args, "--input-csv", str(folder / "*.csv"), "--output-dir", str(tmp_path / "out")]) == 0
    made = json.loads(capsys.readouterr().out)
    document = D.read(made["bundle"])
    B.validate_bundle(document)
    assert sorted(document["symbols"]) == ["QQQ", "SPY"] and len(document["provenance"]["raw_artifact_sha256"]) == 64
    for s in ("qqq", "spy"):
        B.validate_quality(D.read(tmp_path / "out" / f"{s}_quality_report.json"))
    alone = ["build-daily-technical-bundle", *args[1:5], "--symbol", "QQQ", "--input-csv", str(folder / "one.txt"), "--output-dir", str(tmp_path / "alone")]
    assert main(alone) == 0
    single = D.read(json.loads(capsys.readouterr().out)["bundle"])
    assert single[D.DERIVED]["QQQ"] == pytest.approx(document[D.DERIVED]["QQQ"], nan_ok=True)


def test_later_lines_win_across_splits(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text("d,s,v\n" + "".join(f"2025-01-01,A,{i}\n" for i in range(1, 2000)))
    raw = files.read_many(spark, str(tmp_path / "x.csv"), {"date": "d", "symbol": "s", "close": "v"})
    assert raw.rdd.getNumPartitions() > 5
    assert [r.close for r in files.ohlcv(raw).collect()] == [1999.0]


def test_csv_written_and_scanned_by_many_tasks(spark, tmp_path, small_splits):
    n = 5000
    days = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")
    frame = spark.range(n, numPartitions=7).select(days.alias("date"), (F.col("id") / 3).alias("x"), F.when(F.col("id") % 2 == 0, 'say "a, b"').alias("t")).orderBy(F.rand(1))
    for path in (str(tmp_path / "in" / "x.csv"), (tmp_path / "y.csv").as_uri()):
        assert files.write_csv(frame, path) == (n, ["date", "x", "t"])
        assert files.csv_shape(path) == (["date", "x", "t"], n, "1990-01-01", "2003-09-09")
    lines = (tmp_path / "in" / "x.csv").read_text().splitlines()
    assert lines[0] == "date,x,t" and len(lines) == n + 1 and [x[:10] for x in lines[1:]] == sorted(x[:10] for x in lines[1:])
    assert (tmp_path / "y.csv").read_text().splitlines() == lines
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["in", "y.csv"]
    empty = files.write_csv(frame.limit(0), str(tmp_path / "z.csv"))
    assert empty == (0, ["date", "x", "t"]) and files.csv_shape(str(tmp_path / "z.csv")) == (["date", "x", "t"], 0, "", "")
