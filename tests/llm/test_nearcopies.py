import random

import numpy as np

import corpus_pipeline
from foldlake.llm import nearcopies, simhash


def brute(rows):
    """The rows that stay: of each component by exact similarity the least doc_id."""

    def shingles(text):
        words = (text or "").lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) * 5 >= len(x | y) * 4:
                label = [label[j] if k == label[i] else k for k in label]
    return sorted({min((rows[i][0]) for i in range(len(rows)) if label[i] == k) for k in set(label)})


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.randrange(10**9)}"
    return words


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two")]
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 1, 3])):
            base = edited(rng, base, rng.randrange(1, max(2, len(base) // 30)))
            rows.append((len(rows), " ".join(base)))
    return rows


def test_links_match_exact_similarity(documents):
    rows = corpus()
    kept = sorted(r.doc_id for r in nearcopies.keep_one(documents(rows)).collect())
    assert kept == brute(rows) and len(kept) < len(rows)


def test_the_stage_finds_copies_with_several_edits(spark, documents):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, 5))) for i in range(12)] + [(12, " ".join(base))] + [(20, " ".join(f"x{i}" for i in range(300)))]
    fps = [simhash.simhash(simhash.shingle_hashes(t)) for _, t in rows[:13]]
    assert any((fps[12] ^ f).bit_count() > simhash.RADIUS for f in fps)
    unique = corpus_pipeline.near_dedup(spark, documents(rows), "")
    assert sorted(r.doc_id for r in unique.collect()) == brute(rows)
    assert unique.columns == documents(rows).columns


def test_unlike_texts_stay_whatever_their_id(documents):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    kept = nearcopies.keep_one(documents([(None, a), (None, b), (None, b), (2, c), (2, d), (2, d)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(2, c), (2, d)]
    assert sorted(r.text for r in kept if r.doc_id is None) == [a, b]
    assert nearcopies.keep_one(documents([])).collect() == []


def test_candidates_are_near_fingerprints(spark):
    rng = random.Random(5)
    sets = []
    for n in (3, 40, 41, 400, 1200):
        base = [rng.randrange(1 << 64) for _ in range(n)]
        # further and further from the first, then texts of their own
        sets += [base, *([*base[k:], *(rng.randrange(1 << 64) for _ in range(k))] for k in {n // d for d in (3, 4, 6, 9, 12, 20)} if k)]
        sets += [[rng.randrange(1 << 64) for _ in range(n)] for _ in range(6)]
    sets = [np.unique(np.array(s, np.uint64)) for s in sets]
    marks = np.array([nearcopies.words(s) for s in sets])
    assert marks[:, 0].tolist() == [simhash.simhash(s) for s in sets]
    apart = np.bitwise_count(marks[:, None] ^ marks)
    sizes = np.array([len(s) for s in sets])
    near = (apart[:, :, 0] <= nearcopies.RADIUS) & (apart.sum(axis=2, dtype=int) <= nearcopies.WIDE) & nearcopies.may(sizes[:, None], sizes)
    want = list(range(len(sets)))
    for i, j in np.argwhere(near).tolist():
        want = [min(want[i], want[j]) if k in (want[i], want[j]) else k for k in want]
    assert len(set(want)) < len(sets)
    rows = spark.createDataFrame([(i, int(n), w.tobytes()) for i, (n, w) in enumerate(zip(sizes, marks, strict=True))], "fp long, size int, words binary")
    for tile in (nearcopies.TILE, 4):
        pairs = nearcopies.candidates(rows, tile).collect()
        # a forest of each pair of tiles
        assert tile < len(sets) or len(pairs) < 3 * len(sets)
        roots = {r.fp: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert [roots.get(i, i) for i in range(len(sets))] == want
    assert nearcopies.candidates(rows.limit(0)).collect() == []


def test_a_component_in_parts_gives_the_same_links(spark):
    rng = random.Random(6)
    base = [rng.randrange(1 << 62) for _ in range(100)]
    sets = [sorted([*base[:90], *(rng.randrange(1 << 62) for _ in range(k))]) for k in (1, 2, 5, 8, 12, 14, 30, 40) for _ in range(4)]
    rows = [(i, 0, nearcopies.words(np.array(s, np.uint64)).tobytes(), s) for i, s in enumerate(sets)] + [(100, 100, nearcopies.words(np.array(sets[0], np.uint64)).tobytes(), sets[0])]
    members = spark.createDataFrame(rows, "fp long, root long, words binary, own array<long>")
    like = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len({*x} & {*y}) * 5 >= len({*x} | {*y}) * 4]
    want = list(range(len(sets)))
    for i, j in like:
        want = [min(want[i], want[j]) if k in (want[i], want[j]) else k for k in want]
    assert 1 < len(set(want)) < len(sets)
    for held, total in ((1024, 1 << 21), (5, 1 << 21), (1024, 700)):
        pairs = nearcopies.confirmed(members, held, total).collect()
        assert {(p.a, p.b) for p in pairs} <= {*like}
        roots = {r.fp: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert [roots.get(i, i) for i in range(len(sets))] == want
