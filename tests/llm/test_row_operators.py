"""Sharding, URL filters, media, packing and language identification against plain versions."""

import hashlib
import wave
import zlib
from io import BytesIO

import numpy as np
import pytest
from compare import connect, rows_of
from pyspark.sql import functions as F

from odd import ODD
from sextant.llm import language_id, media, packing, sharding, url_filters

SF = "/root/testdata/sf0.001"


def jump(key: int, n: int) -> int:
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_shards_equal_the_loop(spark):
    keys = [*range(300), -1, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shards(F.col("k"), 24).alias("s")).collect()
    assert all((r.s.shard, r.s.grown) == (jump(r.k, 24), jump(r.k, 25)) for r in rows)
    assert all(jump(k, 25) in (jump(k, 24), 24) for k in keys)


def test_sharded_documents(spark, documents):
    found = sharding.shard_documents(documents(ODD).withColumn("shard", F.lit("clash")), 3).toPandas()
    assert len(found) == len(ODD)
    for _, g in found.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        row = found[found.doc_id == i].iloc[0]
        assert (row["size"], row.text_crc32, row["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
    assert sharding.shard_documents(documents([]), 3).count() == 0


def test_url_query_equals_plain_form(spark):
    got = rows_of(url_filters.op9_url_filters(spark, SF).toPandas())
    assert got == rows_of(connect(SF).sql(url_filters.OP9_SQL).df())


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://EXAMPLE.net/en/x?q#f", "example.net", "/en/x", "example.net/en/", "allow"),
        ("http://a.example.net/de/", "a.example.net", "/de/", "net/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.net?utm_source=a", "x.net", "", None, "block"),
        ("http://x.net/?a=http://y.org/fr/", "x.net", "/", "net/", "block"),
        ("http://w.de/a.html", "w.de", "/a.html", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string")
    r = url_filters.judge_urls(pages).first()
    assert (r.host, r.path, r["rule"], r.verdict) == (host, path, rule, verdict)


def test_rules_go_under_their_rarest_token():
    rules = (url_filters.PatternRule("r", "a.*b", ("a", "b"), "block"), url_filters.PatternRule("s", "c", ("c",), "allow"))
    assert set(url_filters.index_rules(rules, {"a": 9, "b": 2})) == {"b", "c"}
    with pytest.raises(ValueError, match="without literal"):
        url_filters.index_rules((url_filters.PatternRule("t", ".", (), "block"),), {})


def test_media_round_trip(spark, documents):
    found = media.media_digests(documents(ODD)).toPandas().set_index("doc_id")
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        row = found.loc[i]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert row.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.store(payload)
        with wave.open(BytesIO(stored)) as w:
            assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == payload
        assert (row.media_bytes, row.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert found.loc[3].equals(found.loc[4]) and found.loc[8].equals(found.loc[9])
    assert media.media_digests(documents([])).count() == 0


def test_resampling_equals_filtering_the_stuffed_signal():
    x = np.random.default_rng(0).normal(size=500).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        phases, got = media._phases(up, down), media.resample(x, up, down)
        padded = np.concatenate([np.zeros(media.TAPS // 2 - 1), x, np.zeros(media.TAPS // 2 + 1)])
        want = [padded[k * down // up :][: media.TAPS] @ phases[k * down % up] for k in range(len(got))]
        assert np.allclose(got, want, atol=1e-4)


def test_hysteresis_and_tensors():
    assert media.segments(np.array([-30, -20, -10, -20, -30, -20, -15])) == [(2, 4), (6, 7)]
    batch = media.tensor_batch(media.store(media.to_payload("abc " * 9000)))
    assert batch.schema.field("log_mel").type.shape == [media.TENSOR_FRAMES, media.MELS]
    assert batch.column("start_s")[1].as_py() == pytest.approx(batch.column("end_s")[0].as_py())


def test_tensors_are_written(spark, documents, tmp_path):
    import pyarrow.parquet as pq

    cells = media.audio_features(documents(["some sound " * 500, None]))
    media.write_tensors(cells, str(tmp_path / "t"))
    read = pq.read_table(tmp_path / "t")
    assert read.num_rows == cells.count() and read.schema.field("log_mel").type.shape == [media.TENSOR_FRAMES, media.MELS]


def test_both_tokenizers_agree_where_the_fast_one_is_used():
    e = packing.Encoder("byte_bpe_50k")
    for c in range(packing.FAST_UP_TO + 1):
        for t in (chr(c), f"a{chr(c)}b", f" {chr(c)}{chr(c)} x", f"1{chr(c)} \n{chr(c)}"):
            assert np.array_equal(e.exact(t), e._fast.encode_to_numpy(t, disallowed_special=()))


def test_cuts_are_the_cheapest():
    params = packing.PackingParams(length=10, power_sizes=(4, 8))
    rng = np.random.default_rng(1)
    for _ in range(60):
        pos = np.sort(rng.choice(np.arange(1, 41), 14, replace=False))
        pos = np.unique(np.concatenate([pos, np.arange(5, 41, 5)]))
        pen = rng.integers(0, 6, len(pos)).astype(float)
        points, best = [0, *pos.tolist()], {0: 0.0}
        for p, x in zip(pos.tolist(), pen, strict=True):
            best[p] = min(best[q] + (0 if p - q in (4, 8) else 10 - (p - q)) for q in points if 0 < p - q <= 10) + x
        cuts = packing.best_cuts(pos, pen, 0, params, True)
        cost, last = 0.0, 0
        for c in cuts:
            cost += (0 if c - last in (4, 8) else 10 - (c - last)) + pen[pos.tolist().index(c)]
            last = c
        assert cuts[-1] == pos[-1] and cost == pytest.approx(best[int(pos[-1])])


def test_packed_pieces_make_up_the_documents(spark, documents):
    texts = ODD + [" ".join(f"Word{i}." for i in range(n)) for n in (10, 900, 2500)]
    pieces = packing.pack_documents(documents(texts), with_ids=True).toPandas()
    e = packing.Encoder("byte_bpe_50k")
    for i, t in enumerate(texts):
        own = pieces[pieces.doc_id == i].sort_values("start")
        ids = [x for p in own.ids for x in p]
        assert ids == [*e.exact(t or "").tolist(), 1] and set(own.doc_tokens) == {len(ids)}
        assert list(own.start) == list(np.cumsum([0, *own.length])[:-1])
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(own.ids, own.ids_crc32, strict=True))
    for _, w in pieces.groupby("sequence_id"):
        w = w.sort_values("offset")
        assert w.length.sum() <= 2048 and list(w.offset) == list(np.cumsum([0, *w.length])[:-1])
    assert packing.pack_documents(documents([])).count() == 0


def test_padding_is_small(spark):
    row = packing.padding(packing.op1_packing(spark, "/root/testdata/sf0.01")).first()
    assert row.padding < 0.02 * row.ids


def test_languages_held_out(spark):
    found = language_id.op2_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n"))
    assert right.first().n > 100 and right.first().a > 0.97
    assert {r.doc_id: r.held_out for r in found.collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1000)}


def test_languages_of_odd_texts(spark, documents):
    found = {r.doc_id: r for r in language_id.identify_languages(documents(ODD, langs=["en", None] * 5)).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2))
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in language_id.identify_languages(documents(ODD, langs=[None] * 10)).collect()} == {"und"}
    assert language_id.identify_languages(documents([])).count() == 0


def test_penalties_make_weights_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.arange(50), np.where(np.arange(50) == 7 * y, 1.0, rng.random(50) * 0.05), y) for y in (0, 1) * 200]
    params = language_id.LanguageParams(buckets=64, l1=1.0)
    w = language_id.fit_ftrl(rows, 2, params)
    assert (w == 0).mean() > 0.5 and all((x @ w[ids] + w[-1]).argmax() == y for ids, x, y in rows)


def test_temperature_softens_overconfident_scores():
    scores, labels = np.tile([[4.0, 0.0]], (100, 1)), np.array([0] * 70 + [1] * 30)
    t = language_id.fit_temperature(scores, labels)
    assert language_id.softmax(scores[:1] / t)[0, 0] == pytest.approx(0.7, abs=0.01)


def test_letterless(spark):
    f = language_id.Features(1024)
    assert f.counts("123 --- 😀") is None and f.counts(None) is None and f.counts("ß") is not None
