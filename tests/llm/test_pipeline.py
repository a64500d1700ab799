"""The pipeline's stages against plain versions, on a small corpus."""

import random

import corpus_pipeline
from foldlake.llm import mixing, queries, repetition, surrogates

from test_simhash import brute_components, brute_fingerprint


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(80):
        words = [f"t{rng.randrange(5000)}" for _ in range(rng.randrange(40, 200))]
        text = " ".join(words)
        rows.append((len(rows), text + (f" mail a{i}@mail1.example.com" if i % 5 == 0 else ""), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c"])))
        if i % 4 == 0:
            rows.append((len(rows), rows[-1][1], "en", "b"))
        if i % 7 == 0:
            rows.append((len(rows), text[: len(text) // 2] + "\n" + "spam ham eggs " * 60, "en", "a"))
    return rows


def test_each_stage_does_its_part(spark, documents):
    rows = corpus()
    docs = documents(rows)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, "")
    want = {r[0] for r in rows if repetition.measure([r[1]], corpus_pipeline.QUALITY)["kept"][0]}
    assert {r.doc_id for r in kept.collect()} == want < {r[0] for r in rows}
    # short texts stay, empty ones go
    few = documents([(1, "a clean line"), (2, None), (3, " \n"), (4, "one")])
    assert {r.doc_id for r in stages["quality"](spark, few, "").collect()} == {1, 4}
    left = [r for r in rows if r[0] in want]
    unique = stages["near_dedup"](spark, documents(left), "")
    fps = [brute_fingerprint(r[1]) for r in left]
    heads = set(brute_components(fps, [r[0] for r in left]))
    assert {r.doc_id for r in unique.collect()} == heads and len(heads) < len(left)
    assert unique.columns == docs.columns
    private = stages["private_data"](spark, unique, "")
    texts = {r[0]: r[1] for r in rows}
    assert {r.doc_id: r.text for r in private.collect()} == {d: surrogates.replaced(texts[d], queries.surrogate_key(spark))[0] for d in heads}
    mixed = stages["mixing"](spark, private, "")
    got = {r.doc_id for r in mixed.collect()}
    own = {r.doc_id: r for r in mixing.weighted(private).collect()}
    assert got == {d for d, r in own.items() if r.mix_sampled} and got
    packed = stages["packing"](spark, mixed, "").collect()
    assert {r.doc_id for r in packed} == got


def test_the_run_is_its_stages(spark, documents, tmp_path):
    documents(corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = documents(corpus())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in out) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.collect())
