import hashlib
import random

from hypothesis import given, settings, strategies as st

from foldlake.llm import piecewise


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ABC/", max_size=64), st.text("ABC/", max_size=64)), min_size=1, max_size=6))
def test_distances(pairs):
    a, b = zip(*pairs, strict=True)
    assert piecewise.distances(list(a), list(b)).tolist() == [levenshtein(x, y) for x, y in pairs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6))
def test_a_fingerprint_depends_on_the_text_alone(texts):
    assert piecewise.fingerprints(texts) == [piecewise.fingerprints([t])[0] for t in texts]
    for f in piecewise.fingerprints(texts):
        k, one, two = f.split(":")
        assert int(k) >= 0 and len(one) <= 64 and len(two) <= 64


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_edits_stay_near_and_others_far():
    rng = random.Random(1)
    for n in (40, 300, 3000):
        a, b = prose(rng, n), prose(rng, n)
        changed = piecewise.edited(a, b)
        x, y, z = piecewise.fingerprints([a.encode(), changed.encode(), b.encode()])
        near, far = piecewise.likeness([(x, y), (x, z)])
        assert near > 0.35 > 0.2 > far


def brute(rows):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, t) in enumerate(order):
        follow = order[(i + 1) % len(order)][1]
        n = len(t) // 3
        new = t[: len(t) - n] + follow[:n]
        f, g, h = piecewise.fingerprints([t.encode(), new.encode(), follow.encode()])
        near, other = piecewise.likeness([(f, g), (f, h)])
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), f, g, near, other))
    return sorted(out, key=repr)


def test_neighbours_match_brute_force(documents, odd_rows):
    rng = random.Random(2)
    rows, seen = [], set()
    for r in odd_rows + [(100 + 3 * i, prose(rng, rng.randrange(80))) for i in range(60)]:
        if r[0] not in seen:  # an order of equal ids is by a hash
            seen.add(r[0])
            rows.append(r[:2])
    assert sorted((tuple(r) for r in piecewise.neighbours(documents(rows)).collect()), key=repr) == brute(rows)


def test_one_row_and_none(documents):
    assert [tuple(r) for r in piecewise.neighbours(documents([(5, "abcdef")])).collect()] == brute([(5, "abcdef")])
    assert piecewise.neighbours(documents([])).collect() == []


def test_repeated_rows_stay(documents):
    got = piecewise.neighbours(documents([(1, "same"), (1, "same"), (1, "same")])).collect()
    assert len(got) == 3 and {r.near_next for r in got} == {1.0}
