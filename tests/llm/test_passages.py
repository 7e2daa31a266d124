"""Buckets of op6: passages that walks meet."""

import random
from itertools import combinations

import numpy as np
from sextant.llm import edit_embedding as E

PARAMS = E.NearParams()
SYLLABLES = "the and ing ion tio ent er re on an th he in at es st nd ou ea".split()


def prose(rng, n):
    out = ""
    while len(out) < n:
        out += "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) + rng.choice([" ", " ", " ", ". "])
    return out[:n]


def keys_of(texts):
    embed = E.Embedder()
    prints, passages = embed.with_passages(texts, PARAMS.distance)
    back = embed.passages_back(texts, PARAMS.distance)
    return [set(E.filed(len(t), f, np.concatenate([p, b]), embed, PARAMS).tolist()) for t, f, p, b in zip(texts, prints, passages, back, strict=True)]


def edit(rng, text, edits, low=0):
    copy = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(low, len(copy)), rng.randrange(3)
        copy[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice("abcdefgh ")]
    return "".join(copy)


def test_unrelated_texts_share_no_bucket():
    """Bands of six samples agree by chance in a number of pairs that grows with the square of the texts."""
    rng = random.Random(1)
    texts = [prose(rng, 1200 + i % 20) for i in range(1500)]
    owners = {}
    for i, keys in enumerate(keys_of(texts)):
        for k in keys:
            owners.setdefault(k, []).append(i)
    pairs = {p for own in owners.values() for p in combinations(own, 2)}
    assert len(pairs) <= 5
    embed = E.Embedder()
    owners = {}
    for i, (t, f) in enumerate(zip(texts, embed.fingerprints(texts), strict=True)):
        for k in E.bucket_keys(f, len(t), embed, PARAMS):
            owners.setdefault(k, []).append(i)
    assert len({p for own in owners.values() for p in combinations(own, 2)}) > 20 * max(1, len(pairs))


def test_near_texts_of_any_length_share_a_bucket():
    """Across the change from bands to passages, and of texts whose first edits put the walk out of step."""
    rng, pairs = random.Random(2), []
    for i in range(240):
        base = prose(rng, rng.choice([60, 150, 560, 590, 600, 610, 680, 710, 1300, 1400, 4000]))
        pairs.append((base, edit(rng, base, max(1, int(len(base) * (0.005, 0.01, 0.019)[i % 3])))))
    for _ in range(60):  # ten characters more at the start, and nothing else
        base = prose(rng, rng.randrange(700, 3000))
        pairs.append((base, base[:5] + prose(rng, 10) + base[5:]))
    keys = keys_of([t for p in pairs for t in p])
    found = [bool(a & b) for a, b in zip(keys[::2], keys[1::2], strict=True)]
    assert sum(found[:240]) >= 0.97 * 240 and all(found[240:])


def test_thinned_links_connect_the_same(spark):
    rng = random.Random(3)
    pivots = [5, 900, 17, 44]
    links = {(min(p, o), max(p, o), p) for o in range(100, 400) for p in rng.sample(pivots, rng.randint(1, 4))}
    found = E._thinned(spark.createDataFrame(sorted(links), "a long, b long, p long")).collect()

    def parts(ends):
        parent = {}

        def root(v):
            while parent.setdefault(v, v) != v:
                v = parent[v]
            return v

        for a, b in ends:
            parent[root(a)] = root(b)
        out = {}
        for v in list(parent):
            out.setdefault(root(v), set()).add(v)
        return sorted(map(sorted, out.values()))

    assert parts([(r.a, r.b) for r in found]) == parts([(a, b) for a, b, _ in links])
    assert len(found) <= 300 + len(pivots) ** 2 < len(links)


def test_pairs_far_beyond_the_distance_are_given_up_early(monkeypatch):
    """Words exchanged all over a text: the bags let such pairs through, and all edits allowed were tried on them."""
    rng, looks = random.Random(5), []
    runs = E._runs
    monkeypatch.setattr(E, "_runs", lambda flat, x, y: looks.append(len(x)) or runs(flat, x, y))
    base = prose(rng, 4000)
    words = base.split(" ")
    for i in rng.sample(range(len(words)), len(words) // 12):
        words[i] = prose(rng, len(words[i]))
    most = int(0.02 * 4000)
    far = " ".join(words)
    assert E.edit_distance_within(base, far, most) is None and sum(looks) < most * most // 2
    exact = E.edit_distance_within(base, far, 2000)
    assert E.edit_distance_within(base, far, exact) == exact and E.edit_distance_within(base, far, exact - 1) is None


def test_walks_go_on_where_a_window_ends(monkeypatch):
    """Texts whose walks differ in their steps, with windows and cells that end within them."""
    rng = random.Random(6)
    texts = ["".join(rng.choices(letters, k=n)) for letters in ("ab", "xyz ", "é😀 k") for n in (1, 63, 64, 65, 700, 5000)] + [""]
    plain, keys = E.Embedder().with_passages(texts, PARAMS.distance)
    monkeypatch.setattr(E, "LEAP_STEPS", 64)
    monkeypatch.setattr(E, "WALK_CHARS", 3000)
    monkeypatch.setattr(E.Leaps, "KEPT", 640)
    again, others = E.Embedder().with_passages(texts, PARAMS.distance)
    assert all(a[0] == b[0] and (a[1] == b[1]).all() for a, b in zip(plain, again, strict=True))
    assert all(np.array_equal(a, b) for a, b in zip(keys, others, strict=True))


def test_components_look_at_links_once(spark, monkeypatch):
    """A family whose links are many: each round shuffled all of them, though one joins them."""
    from sextant.llm import ngram_join as N

    rows, written = [], N.written

    def counted(df, name):
        out = written(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(N, "written", counted)
    pairs = [(1 + i % 5, 100 + i) for i in range(400)] + [(1 + i, 2 + i) for i in range(4)] + [(900, 901), (901, 902), (777, 777)]
    found = {r.key: r.label for r in N.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {k: 1 for k in [*range(1, 6), *range(100, 500)]} | {900: 900, 901: 900, 902: 900, 777: 777}
    assert rows.count(0) == 1 and max(rows) < 2 * len(pairs)
