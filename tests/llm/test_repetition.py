import random
import re

from hypothesis import given, settings, strategies as st

from foldlake.llm import repetition
from foldlake.llm.repetition import Limits


def brute(text, limits):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, w = len(words), limits.window
    windows = [tuple(words[i : i + w]) for i in range(n - w + 1)]
    in_window = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + w)}
    covered, longest = set(), 0
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= limits.min_repeat:
                covered |= set(range(i, i + k)) | set(range(j, j + k))
                longest = max(longest, k)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = n < limits.min_words or 100 * len(in_window) > limits.max_repeat_words * n
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(in_window), "base_failed": failed, "kept": not failed and len(covered) <= limits.max_covered * n and longest <= limits.max_longest,
        "covered_words": len(covered), "longest_repeat": longest,
    }


def same(texts, limits):
    found = repetition.measure(texts, limits)
    for i, t in enumerate(texts):
        assert {k: v[i].item() for k, v in found.items()} == brute(t, limits)


SMALL = Limits(min_words=3, min_repeat=3, max_longest=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n#é", max_size=60)), min_size=1, max_size=5))
def test_figures_match_brute_force(texts):
    same(texts, SMALL)


def test_repeated_passages():
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 120))]
        passage = words[: rng.randrange(1, 40)]
        texts.append(" ".join(words + passage * rng.randrange(3)) + "\n" * rng.randrange(2) + "x y z" * rng.randrange(2))
    same(texts, Limits())
    same(texts, SMALL)


def test_maximal_repeats():
    assert repetition.maximal_repeats([1, 2, 3, 1, 2, 3, 4, 1, 2]) == [(3, [0, 3]), (2, [0, 3, 7])]
    assert repetition.maximal_repeats([5, 5, 5]) == [(2, [0, 1]), (1, [0, 1, 2])]
    assert repetition.maximal_repeats([1, 2, 3]) == [] and repetition.maximal_repeats([]) == []


def test_the_verdict_needs_long_repeats(documents):
    rng = random.Random(4)
    clean = " ".join(f"u{rng.randrange(10**6)}" for _ in range(400))
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(120))
    rows = [(1, clean), (2, clean + " " + passage + " and " + passage), (3, "short text"), (4, "same words here " * 100)]
    got = {r.doc_id: r for r in repetition.rules(documents(rows)).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert not got[2].base_failed and got[2].longest_repeat == 120
    assert [r.doc_id for r in repetition.keep(documents(rows)).collect()] == [1]


def test_odd_rows_and_clashing_columns(documents, odd_rows):
    docs = documents(odd_rows)
    got = repetition.rules(docs).collect()
    assert len(got) == len(odd_rows)
    for r, (_, text, *_) in zip(got, odd_rows, strict=True):
        assert r.n_words == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert repetition.keep(docs).columns == docs.columns
    assert repetition.rules(documents([])).collect() == []
