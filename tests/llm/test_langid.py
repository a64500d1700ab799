import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.llm import langid

SF = "/root/testdata/sf0.01"


def brute_marginals(emit, move):
    """Sums over all paths, for short sequences."""
    import itertools

    n, k = emit.shape
    total = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = np.prod([emit[i, s] for i, s in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:], strict=False)])
        for i, s in enumerate(path):
            total[i, s] += p
    return total / total.sum(axis=1, keepdims=True)


def test_forward_backward_matches_all_paths():
    rng = np.random.default_rng(0)
    move = rng.random((3, 3)) + 0.1
    lengths = [6, 4, 4, 1]
    emits = [rng.random((n, 3)) + 0.05 for n in lengths]
    gamma, moves = langid._forward_backward(np.concatenate(emits), move, np.array(lengths))
    assert np.allclose(gamma, np.concatenate([brute_marginals(e, move) for e in emits]))
    assert np.isclose(moves.sum(), sum(n - 1 for n in lengths))


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, langid.predict(docs)


def test_held_out_accuracy(predicted):
    docs, found = predicted
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switched_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.sample(docs))
    rows = docs.where(~langid.held_out(F.col("doc_id")) & F.length("text").between(500, 3000)).select("text", "lang").collect()
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append([w for w in r.text.split() if w.isalpha()])
    rng, hits, total = random.Random(1), 0, 0
    own = langid.Labeller(model)
    for _ in range(30):
        words, truth = [], []
        for lang in rng.sample(sorted(by), 3):
            part = rng.choice(by[lang])[:20]
            words += part
            truth += [lang] * len(part)
        gamma, _ = own.marginals([" ".join(words)])[0]
        hits += sum(model.langs[k] == t for k, t in zip(gamma.argmax(axis=1), truth, strict=True))
        total += len(truth)
    assert hits / total > 0.9
    found = langid.segments(docs.limit(20), model).collect()
    assert found and all(r.first_word < r.end_word for r in found)


def test_odd_rows(documents, odd_rows):
    letters = [(200 + i, "der die das und nicht", "de", "s") for i in range(9)] + [(300 + i, "the and of with this", "en", "s") for i in range(9)]
    docs = documents([*odd_rows, *letters, (400, "123 ... !!", "en", "s")])
    got = {}
    for r in langid.predict(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {i for i in (1, 2, 3, 10, 400) if got[i][0].lang_pred == "und" and got[i][0].score == 0} == {1, 2, 3, 10, 400}
    assert len(got[4]) == 2 and got[4][0] == got[4][1]
    assert got[201][0].lang_pred == "de" and got[301][0].lang_pred == "en"


def test_nothing_to_learn_from(documents):
    assert langid.predict(documents([])).collect() == []
    rows = langid.predict(documents([(1, "some words", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
