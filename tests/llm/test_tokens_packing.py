import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from foldlake.llm import eliasfano, packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = tokens.read_spec(PATH)
OWN = tokens.PieceEncoder(SPEC, 600)
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    """By the library as it comes."""
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def own_ids(own, text):
    return own.encode(pa.array([text]))[0].tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t.,'s|* 　tre!éß0Aa<")), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_pieces_give_the_librarys_ids(text):
    assert own_ids(OWN, text) == ids_of(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list(" \n\0a.b<|é")), max_size=30), st.sampled_from(["<|endoftext|>", "a <|endoftext|>b", "x" * 200, "a\n\nb", "a\n\n\nb"])), max_size=12))
def test_a_batch_gives_each_texts_ids(texts):
    ids, bounds = OWN.encode(pa.array(texts, pa.string()), 7)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [[*ids_of(t), 7] for t in texts]
    assert len(OWN.pieces.new) + len(OWN.pieces.old) < 1500


@pytest.mark.parametrize("text", ["a  b", "a \nb", "a\n b", "a\n\nb", "\n", " ", "a ", " a", "it's o'clock", "x  y", "<|endoftext|> a", "don't .. 'll 12 3", "\r\n a", "²½ x² Ⅷ", "a​b c", "hello <|endoftext|> x", "a\n\nb", "\na", "a\n", "a\n b", "a\n\n b", "a\n\n\nb", "\0 a\0"])
def test_edges_between_pieces(text):
    assert own_ids(OWN, text) == ids_of(text)


def test_other_tokenizers_are_given_whole_texts():
    spec = tokens.read_spec(public_tokenizers.path("word_bpe_49k.json"))
    own = tokens.PieceEncoder(spec)
    plain = Tokenizer.from_str(spec)
    assert own_ids(own, "Some Text, here.") == plain.encode("Some Text, here.", add_special_tokens=False).ids


def rows_for_packing(odd_rows):
    rng = random.Random(3)
    odd_rows = [(d if d != 4 else 4 + 10_000 * k, *r) for k, (d, *r) in enumerate(odd_rows)]
    return odd_rows + [(100 + i, " ".join(rng.choice(["the", "token", "packing", "é"]) for _ in range(rng.randrange(2500)))) for i in range(150)]


def test_packing_holds_each_id_once(documents, odd_rows):
    rows = rows_for_packing(odd_rows)
    got = packing.pack(documents(rows), SPEC).collect()
    want = Counter()
    for d, t, *_ in rows:
        ids = np.array([*ids_of(t), 0], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes()) if len(ids) <= 1024 else None] += 1
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        assert 1 <= r.length <= 1024
    assert sum(r.length for r in got) == sum(k[1] * n for k, n in want.items())
    texts = {d: t for d, t, *_ in rows}
    for (d, total), pieces in by_doc.items():
        copies = sum(n for k, n in want.items() if k[:2] == (d, total))
        assert Counter(p for r in pieces for p in range(r.start, r.start + r.length)) == Counter({p: copies for p in range(total)})
        ids = np.array([*ids_of(texts[d]), 0], "<u4")
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 1024 - at
    assert sorted(sequences) == list(range(len(sequences)))
    assert padding < 1024


def test_packing_of_nothing(documents):
    assert packing.pack(documents([]), SPEC).collect() == []


def best_sum(counts, window):
    longest = max(counts)
    sums = {longest}
    for length, n in counts.items():
        for _ in range(n - (length == longest)):
            sums |= {s + length for s in sums if s + length <= window}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8))
def test_a_filling_is_the_closest_one(counts):
    found = packing.fill(dict(counts), 40)
    assert all(n <= counts[length] for length, n in found.items()) and max(counts) in found
    assert sum(k * n for k, n in found.items()) == best_sum(counts, 40)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), min_size=1, max_size=8))
def test_all_windows_but_one_are_full(counts):
    slots = packing.Slots(dict(counts), 40)
    slots.sort()
    held = defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            at = 0
            for start, size, sequence, offset in slots.places(length, rank):
                assert start == at and size > 0
                at += size
                held[sequence].append((offset, size))
            assert at == length
    assert sorted(held) == list(range(slots.sequences))
    ends = []
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        ends.append(at)
    assert sum(e < 40 for e in ends) <= 1 and max(ends) <= 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=700))
def test_elias_fano_gives_back_what_it_got(values):
    values = sorted(values)
    own = eliasfano.EliasFano.encode(np.array(values, np.int64), values[-1] if values else 0)
    back, _ = eliasfano.EliasFano.from_bytes(own.to_bytes())
    assert back.values().tolist() == values
    for i in range(0, len(values), 37):
        assert back.select(i) == values[i]


def test_elias_fano_is_small():
    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, 10**9, 100_000))
    assert len(eliasfano.EliasFano.encode(values, 10**9).to_bytes()) * 8 / 100_000 < np.log2(10**4) + 2.3


def test_token_files_round_trip(documents, odd_rows, tmp_path):
    rows = rows_for_packing(odd_rows)
    manifest = eliasfano.write(documents(rows), SPEC, file_ids=20_000, folder=str(tmp_path / "out"))
    got = [tuple(r) for r in eliasfano.read(manifest).collect()]
    assert sum(r.n_ids for r in manifest.collect()) == sum(len(ids_of(t)) + 1 for _, t, *_ in rows) and manifest.count() > 5
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ((d, [*ids_of(t), 2]) for d, t, *_ in rows))
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    ids = [r[0] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    file = eliasfano.TokenFile((tmp_path / "out" / manifest.first().path.rsplit("/", 1)[1]).read_bytes())
    texts = {d: t for d, t, *_ in rows}
    for i, d in list(enumerate(file.doc_ids()))[:5]:
        assert file.document(i).tolist() == [*ids_of(texts[d]), 2]


def test_token_files_of_other_doc_ids(spark):
    for kind, names in (("string", [None, "", "a", "a", "b", "ü"]), ("int", [None, -(1 << 31), -1, 0, 5, (1 << 31) - 1]), ("bigint", [None, -(1 << 63), -1, 0, 5, (1 << 63) - 1])):
        docs = spark.createDataFrame([(n, f"text {n}") for n in reversed(names)], f"doc_id {kind}, text string")
        got = eliasfano.read(eliasfano.write(docs, SPEC, file_ids=8), kind).orderBy("start").collect()
        assert [r.doc_id for r in got] == names
        assert [r.n_tokens for r in got] == [len(ids_of(f"text {n}")) + 1 for n in names]


def test_token_files_of_nothing(documents):
    assert eliasfano.read(eliasfano.write(documents([]), SPEC)).collect() == []


def test_a_damaged_file_is_told():
    data = bytearray(eliasfano.pack_file(pa.array([1, 2]), np.array([2, 1]), np.array([5, 6, 7], "<u2").tobytes(), 2))
    assert eliasfano.TokenFile(bytes(data)).document(1).tolist() == [7]
    data[-1] ^= 1
    with pytest.raises(ValueError):
        eliasfano.TokenFile(bytes(data))


def test_packing_gives_memory_back_after_each_slice(monkeypatch):
    given_back, texts = [], [f"some words {i}" for i in range(2 * packing.ROWS + 1)]
    monkeypatch.setattr(packing.common, "release", lambda real=packing.common.release: given_back.append(real()))
    batches = iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])])
    seen, found = 0, []
    for k, (batch, ids, bounds) in enumerate(packing.encoded(batches, OWN, packing.END_ID)):
        assert len(batch) <= packing.ROWS and len(given_back) == k
        found += [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)]
        seen += 1
    assert seen == len(given_back) == 3
    assert found == [[*ids_of(t), packing.END_ID] for t in texts]
