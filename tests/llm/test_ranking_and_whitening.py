"""Whitening, MinHash near-duplicates and ranked search against brute force, on odd tables too."""

import math
from collections import Counter

import numpy as np
import pytest
from compare import connect, rows_of
from odd import ODD

from sextant.llm import minhash, ngram_join, search, whitening
from sextant.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_minhash", "op13_search", "embedding_deviation"])
def test_query_equals_twin(spark, name):
    names, got = rows_of(QUERIES[name](spark, SF).toPandas())
    wanted_names, wanted = rows_of(connect(SF).sql(SQL[name]).df())
    assert names == wanted_names
    assert got == wanted


# ---- whitening


def _whitened(vectors: np.ndarray, k: int):
    x = np.floor(vectors.astype(float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1], c[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ c[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def _check(rows, ids, vectors, k=4):
    n, deviation, whitened, explained = _whitened(vectors, k)
    got = rows.toPandas()
    assert len(got) == len(ids) * k and (got["n"] == n).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    signs = np.sign((wide * whitened).sum(0))
    assert np.allclose(wide, whitened * signs, atol=1e-9)
    assert (got[got.component == 1].set_index("vec_id").deviation.loc[ids].to_numpy() == deviation).all()
    assert np.allclose(got.groupby("component").explained.first().to_numpy(), explained, rtol=1e-9)
    assert got.identity_error.max() < 1e-9


def _query(spark, tmp_path, rows, schema="vec_id long, embedding array<float>, label int"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op11_whitening(spark, str(tmp_path))


def test_whitening_equals_brute_force(spark):
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    _check(whitening.op11_whitening(spark, SF), raw.vec_id.to_numpy(), np.stack(raw.embedding.to_numpy()))


def test_whitening_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(40, 5)) * [1, 2, 3, 4, 5] + 1e5).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(good)] + [(100 + i, good[7].tolist(), 1) for i in range(30)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * 4 + [None], [1.0] * 4 + [nan], [inf] + [1.0] * 4, [1.0] * 6]
    rows += [(200 + i, v, None) for i, v in enumerate(bad)]
    ids = [r[0] for r in rows if r[0] < 200]
    _check(_query(spark, tmp_path, rows), ids, np.stack([r[1] for r in rows if r[0] < 200]).astype(np.float32))


def test_whitening_without_variance(spark, tmp_path):
    assert _query(spark, tmp_path, []).count() == 0
    assert _query(spark, tmp_path, [(1, None, 0)]).count() == 0
    same = _query(spark, tmp_path, [(i, [1.0, 2.0], 0) for i in range(3)]).collect()
    assert len(same) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)}
    line = _query(spark, tmp_path, [(None, [float(i), 2.0, 0.0], 0) for i in range(4)]).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}


def test_whitening_of_huge_entries(spark, tmp_path):
    rows = [(0, [1e38, 0.0], 0), (1, [-1e38, 1.0], 0), (2, [1e30, 2.0], 0)]
    got = _query(spark, tmp_path, rows).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got) and all(math.isfinite(r.whitened) for r in got if r.component == 1)
    exact, _ = whitening.whiten(spark.createDataFrame([(0, [3e7], 9.0), (1, [-3e7], 9.0)], "vec_id long, embedding array<double>, whitened double"), "embedding", 4)
    assert exact.schema["deviation"].dataType.simpleString() == "decimal(38,0)" or exact.select("deviation").first()[0] == (2 * 256 * 3 * 10**7) ** 2
    assert {float(r.deviation) for r in exact.collect()} == {float((2 * 256 * 3 * 10**7) ** 2)}


def test_whitening_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PAIRS_PER_PASS", 7)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(30, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows, model = whitening.whiten(df, "embedding", 6)
    values = np.stack([r.whitened for r in rows.orderBy("vec_id").collect()])
    assert np.allclose(np.cov(values.T, bias=True), np.eye(6), atol=1e-9) and model.identity_error < 1e-9


# ---- MinHash


def test_signatures_agree_with_similarity():
    rng = np.random.default_rng(1)
    for size in (5, 40, 400):
        agreed, alike = [], []
        for _ in range(60):
            union = rng.integers(1, 1 << 63, size * 2, dtype=np.uint64)
            a, b = np.unique(union[: int(size * 1.5)]), np.unique(union[int(size * 0.5) :])
            agreed.append((minhash.minima(a, 128) == minhash.minima(b, 128)).mean())
            alike.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agreed) - np.mean(alike)) < 0.05


def test_pairs_at_the_threshold_share_a_bucket():
    rng = np.random.default_rng(2)
    params = minhash.MinHashParams()
    lost = 0
    for size in (5, 9, 30, 100, 1000):
        for _ in range(400):
            union = rng.integers(1, 1 << 63, size, dtype=np.uint64)
            extra = size - -(-80 * size // 100)  # elements that one of the two lacks
            a, b = np.unique(union), np.unique(union[: size - extra])
            (_, x), (_, y) = params.signatures(a)[0], params.signatures(b)[0]
            lost += not np.intersect1d(x, y).size
    assert lost <= 1  # of 2000


def test_small_sets_have_no_signature():
    params = minhash.MinHashParams()
    assert [bool(params.signatures(np.arange(1, n + 1, dtype=np.uint64))) for n in range(1, 7)] == [False, False, False, True, True, True]


def _brute_components(texts, percent=80, width=4):
    sets = [set(ngram_join.shingles(t, width).tolist()) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                common = len(a & sets[j])
                if common and 100 * common >= percent * (len(a) + len(sets[j]) - common) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return [(i, len(s), label[i], label[i] == i) for i, s in enumerate(sets)]


def test_near_components_equal_brute_force(spark, documents):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = list(ODD)
    for _ in range(6):
        base = rng.choice(vocabulary, 120).tolist()
        for edits in (0, 0, 1, 2, 3, 5, 8, 13):  # similarities on both sides of the threshold, chains among them
            copy = list(base)
            for at in rng.integers(0, 120, edits):
                copy[at] = str(rng.integers(1 << 30))
            texts.append(" ".join(copy))
            base = copy
    got = minhash.near_components(documents(texts).withColumnsRenamed({"n_chars": "n_shingles", "lang": "kept"}))
    assert sorted(tuple(r) for r in got.collect()) == _brute_components(texts)


def test_near_components_of_odd_ids(spark):
    schema = "doc_id long, text string"
    assert minhash.near_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, "x y z u v w"), (4, "X Y Z u v w"), (5, "x y z u v w")]
    got = sorted(map(tuple, minhash.near_components(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(None, 3, None, True), (None, 3, None, True), (3, 0, 3, True), (4, 3, 4, True), (4, 3, 4, True), (5, 3, 4, False)], key=repr)


# ---- ranked search


def _brute_ranks(docs, items, top=10):
    split = lambda t: search.terms(t.encode() if t is not None else None)
    counts = [(i, Counter(split(t))) for i, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counts:
            length, score = sum(c.values()), 0
            for t in split(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * length * n) // total
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc))
        out += [(item, i + 1, doc, -s) for i, (s, doc) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_terms():
    assert search.terms("A-b  É1_x\x00\x7f\x80Ÿ 日本,ſ".encode()) == ["a".encode(), b"b", "É1".encode(), b"x", "\x80Ÿ".encode(), "日本".encode(), "ſ".encode()]
    assert search.terms(None) == search.terms(b"") == search.terms(b" ,;\n") == []


@pytest.mark.parametrize("most", [search.ITEM_TERMS, 0])
def test_ranks_equal_brute_force(spark, documents, monkeypatch, most):
    from sextant.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 20)
    rng = np.random.default_rng(6)
    vocabulary = [f"t{i}" for i in range(40)] + ["é", "Ünï"]
    texts = list(ODD) + [" ".join(rng.choice(vocabulary, rng.integers(1, 60))) for _ in range(60)] * 2
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(6)] + [(6, None), (7, "none of these"), (8, "t1 t1 T1"), (9, "word same")]
    table = spark.createDataFrame([(*x, 1) for x in items + items[:2]], "item_id long, text string, score int")
    got = search.ranked(documents(texts).withColumnRenamed("lang", "score"), table, most=most)
    assert sorted(map(tuple, got.select("item", "rank", "doc", "score").collect())) == _brute_ranks(list(enumerate(texts)), items)


def test_ranks_of_odd_tables(spark, documents):
    items = spark.createDataFrame([(None, "alpha"), (None, "beta"), (1, "alpha")], "item_id long, text string")
    assert search.ranked(documents([]), items).count() == 0
    assert search.ranked(documents([None, "", " . "]), items).count() == 0
    assert search.ranked(documents(["alpha"]), items.limit(0)).count() == 0
    docs = spark.createDataFrame([(None, "alpha beta"), (2, "alpha"), (2, "alpha"), (3, "gamma"), (4, "gamma delta")], "doc_id long, text string")
    got = {(r.item, r.rank): r.doc for r in search.ranked(docs, items).collect()}
    assert got == {(None, 1): None, (None, 2): 2, (None, 3): 2, (1, 1): 2, (1, 2): 2, (1, 3): None}


def test_postings_are_bucketed(spark, documents):
    found = search.index(documents(["b a a", "c", None]), "doc_id", "text")
    rows = found.where("term is not null").collect()
    assert sorted((r.id, r.length, r.term, r.tf) for r in rows) == [(0, 3, "a", 2), (0, 3, "b", 1), (1, 1, "c", 1)]
    assert all(0 <= r.bucket < search.BUCKETS for r in rows) and found.where("term is null").count() == 3
