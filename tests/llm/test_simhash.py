import random

import numpy as np
import pytest
import xxhash

from foldlake.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(fps))]


def check(rows, got):
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(((d, f, c) for (d, _), f, c in zip(rows, fps, brute_components(fps, [d for d, _ in rows]), strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == want


def near_copies(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 400))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            if len(words) > 50 and rng.random() < 0.7:
                words[rng.randrange(len(words))] = "changed"
            rows.append((len(rows) * 7 % 1009, " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)))
    return rows


def test_clusters_match_brute_force(documents):
    rows = near_copies()
    check(rows, simhash.cluster(documents(rows), tile=64).collect())


def test_odd_rows(documents, odd_rows):
    rows = [r[:2] for r in odd_rows]
    check(rows, simhash.cluster(documents(odd_rows)).collect())


def test_empty_table(documents):
    assert simhash.cluster(documents([])).collect() == []
    assert simhash.keep_one(documents([])).collect() == []


def test_keeps_one_of_each_group(documents, odd_rows):
    docs = documents(odd_rows + [(d + 100, t) for d, t in near_copies()])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in simhash.cluster(docs).collect()}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(groups, key=repr)


@pytest.mark.parametrize("sizes", [(300, 0), (200, 150), (1, 1)])
def test_a_forest_keeps_all_links(sizes):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)

    def some(n):
        return np.array([int(base[rng.integers(5)]) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for _ in range(n)], np.uint64)

    a, b = some(sizes[0]), some(sizes[1]) if sizes[1] else None
    x, y = simhash.forest(a, b, 4, block=16)
    every = np.unique(a if b is None else np.concatenate([a, b]))
    at = {int(v): i for i, v in enumerate(every)}
    parent = list(range(len(every)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(int(p), int(q)) for p in a for q in (a if b is None else b) if (int(p) ^ int(q)).bit_count() <= 4]
    for p, q in pairs:
        parent[find(at[p])] = find(at[q])
    want = {frozenset(int(v) for v in every if find(at[int(v)]) == r) for r in {find(i) for i in range(len(every))}}
    parent = list(range(len(every)))
    assert len(x) < len(a) + (0 if b is None else len(b))
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        parent[find(at[p])] = find(at[q])
    assert {frozenset(int(v) for v in every if find(at[int(v)]) == r) for r in {find(i) for i in range(len(every))}} == want


def test_tiles_grow_and_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 3))) for b in base for _ in range(4)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = {r.fp: r.root for r in simhash.components(simhash.links(df)).collect()}
    for tile, least, most in ((7, 8192, 1 << 20), (None, 4, 16), (None, 1, 1 << 20)):
        monkeypatch.setattr(simhash, "TILE", least)
        monkeypatch.setattr(simhash, "LARGEST_TILE", most)
        assert {r.fp: r.root for r in simhash.components(simhash.links(df, tile=tile)).collect()} == whole


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000 + i, 1000) for i in range(1, 50)], "a long, b long")
    roots = {r.fp: r.root for r in simhash.components(links).collect()}
    assert roots == {i: 0 for i in range(1, n + 1)} | {1000 + i: 1000 for i in range(1, 50)}


def test_unlike_texts_stay_whatever_their_id(documents):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, d), (2, e), (2, e), (3, d)]
    kept = simhash.keep_one(documents(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(None, a), (None, b), (1, c), (2, d), (2, e)], key=repr)
