"""Codecs, keys, checksums and small functions against known answers and plain versions."""

import hashlib
import random
import time
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from foldlake.functions import aes, bcj2, codecs, crc, native_aes, payload, sizes, streams, udtfs
from foldlake.functions.errors import ArchiveError
from foldlake.operators import benchstats, integrity, planner
from foldlake.sources import header

# NIST SP 800-38A, F.2.5
KEY = bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4")
IV = bytes(range(16))
PLAIN = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411e5fbc1191a0a52eff69f2445df4f9b17ad2b417be66c3710")
CIPHER = bytes.fromhex("f58c4c04d6e5f1ba779eabfb5f7bfbd69cfc4e967edb808d679f777bc6702c7d39f23369a9d9bacfa530e26304231461b2eb05e2c39be9fcda6c19078c6a9d1b")


def test_aes_known_answers():
    assert aes.cbc_encrypt(PLAIN, KEY, IV) == CIPHER and aes.cbc_decrypt(CIPHER, KEY, IV) == PLAIN
    with pytest.raises(ArchiveError):
        aes.cbc_decrypt(CIPHER[:-1], KEY, IV)


def test_aes_engines_agree_and_encryption_is_fast(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(aes, "STEP", 48)
    for n in (0, 1, 15, 16, 17, 47, 48, 49, 200):
        data, key, iv = rng.randbytes(n), rng.randbytes(32), rng.randbytes(rng.choice([0, 8, 16]))
        whole, full = data + bytes(-n % 16), iv.ljust(16, b"\0")
        packed = aes.cbc_encrypt(data, key, iv)
        assert packed == aes._plain_encrypt(whole, key, full)
        assert aes.cbc_decrypt(packed, key, iv) == aes._plain_decrypt(packed, key, full) == whole
    monkeypatch.setattr(aes, "_openssl", lambda: None)
    assert aes.cbc_encrypt(PLAIN, KEY, IV) == CIPHER and aes.cbc_decrypt(CIPHER, KEY, IV) == PLAIN
    monkeypatch.undo()
    data, begun = bytes(1 << 20), time.process_time()
    assert aes.cbc_decrypt(aes.cbc_encrypt(data, KEY, IV), KEY, IV) == data
    assert time.process_time() - begun < 2  # block after block in Python takes half a minute


def test_aes_on_spark(spark):
    df = spark.createDataFrame([(PLAIN, CIPHER), (PLAIN[:16], CIPHER[:16]), (b"", b"")], "p binary, c binary")
    got = df.select("p", "c", native_aes.decrypt(F.col("c"), F.lit(KEY), F.lit(IV)).alias("d"), native_aes.encrypt(F.col("p"), F.lit(KEY), F.lit(IV)).alias("e")).collect()
    assert all(bytes(r.d) == bytes(r.p) and bytes(r.e) == bytes(r.c) for r in got)


def test_key_derivation():
    secret = "pä".encode("utf-16-le")
    want = hashlib.sha256(b"".join(b"salt" + secret + n.to_bytes(8, "little") for n in range(1 << 13))).digest()
    assert aes.derive_key("pä", 13, b"salt") == want
    assert aes.derive_key("pä", 63, b"salt") == (b"salt" + secret).ljust(32, b"\0")
    with pytest.raises(ArchiveError):
        aes.derive_key("x", 25, b"")
    for power, salt, iv in ((19, b"", b""), (5, b"s" * 16, b"i" * 16), (5, b"s", b"i" * 8), (19, b"", b"i" * 16)):
        assert aes.properties(aes.make_properties(power, salt, iv)) == (power, salt, iv.ljust(16, b"\0"))
    for bad in (b"", b"\xc0", b"\xc0\xff\x00"):
        with pytest.raises(ArchiveError):
            aes.properties(bad)


METHODS = ["COPY", "LZMA", "LZMA2", "BZIP2", "DEFLATE", "ZSTD", "LZ4", "BROTLI", *codecs._BRANCH, "BCJ_ARM64", "BCJ_RISCV", "DELTA", "AES256_SHA256"]


@pytest.mark.parametrize("method", METHODS)
@settings(max_examples=25, deadline=None)
@given(data=st.binary(max_size=3000), repeat=st.integers(1, 40), distance=st.integers(1, 256))
def test_coders_round_trip(method, data, repeat, distance):
    data *= repeat
    options = codecs.Options(level=1, distance=distance, power=2, frame=1000 if repeat % 2 else None)
    properties, packed = codecs.encode(method, data, options, "pw")
    assert codecs.decode(method, properties, packed, len(data), "pw") == data


@pytest.mark.parametrize("method", METHODS)
@settings(max_examples=25, deadline=None)
@given(data=st.binary(max_size=3000), repeat=st.integers(1, 40), distance=st.integers(1, 256), cut=st.integers(1, 5000), step=st.integers(1, 3000))
def test_streams_give_the_same(method, data, repeat, distance, cut, step):
    data *= repeat
    properties, packed = codecs.encode(method, data, codecs.Options(level=1, distance=distance, power=2, frame=1000 if repeat % 2 else None), "pw")
    before, streams.STEP = streams.STEP, step
    try:
        parts = (packed[i : i + cut] for i in range(0, len(packed), cut))
        assert b"".join(streams.decoded(method, properties, parts, len(data), "pw")) == data
        if data:
            half = packed[: len(packed) // 2]
            short = (half[i : i + cut] for i in range(0, len(half), cut))
            with pytest.raises(ArchiveError):
                b"".join(streams.decoded(method, properties, short, len(data) + 1, "pw"))
    finally:
        streams.STEP = before


def test_streams_of_several_bzip2_parts():
    import bz2

    packed = bz2.compress(b"one" * 1000) + bz2.compress(b"two" * 1000)
    for cut in (1, 7, 50, 10_000):
        parts = (packed[i : i + cut] for i in range(0, len(packed), cut))
        assert b"".join(streams.decoded("BZIP2", b"", parts, 6000)) == b"one" * 1000 + b"two" * 1000


@pytest.mark.parametrize("method", ["LZMA", "LZMA2", "BZIP2", "DEFLATE", "ZSTD", "LZ4", "BROTLI"])
def test_damaged_data_is_an_error_or_other_bytes(method):
    rng = random.Random(1)
    data = payload.text(3, 20_000)
    properties, packed = codecs.encode(method, data, codecs.Options(level=1))
    for _ in range(30):
        bad = bytearray(packed)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        for part in (bytes(bad), packed[: rng.randrange(len(packed))]):
            try:
                codecs.decode(method, properties, part, len(data))
            except ArchiveError as e:
                assert e.code in ("Corrupted", "UnsupportedMethod")


def test_methods_without_an_engine_are_refused():
    for method in ("LZS", "LIZARD", "DEFLATE64", None):
        with pytest.raises(ArchiveError) as e:
            codecs.decode(method, b"", b"x", 1)
        assert e.value.code == "UnsupportedMethod"


def test_arm64_moves_branches_only():
    words = np.array([0x94000010, 0xD503201F, 0x94000010, 0x90000001], "<u4")
    out = np.frombuffer(codecs.arm64(words.tobytes(), True), "<u4")
    assert out[0] == 0x94000010 and out[1] == words[1] and out[2] == 0x94000012


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0xE8, 0xE9, 0x0F, 0x84, 0, 1, 0xFF, 0x90]), max_size=200))
def test_bcj2_round_trips(data):
    assert bcj2.decode(bcj2.encode(bytes(data)), len(data)) == bytes(data)


def riscv_code(rng, n):
    """Jumps, address pairs and what looks like them."""
    out = bytearray()
    while len(out) < n:
        k, rd = rng.random(), rng.choice([0, 1, 2, 5, 10])
        if k < 0.2:
            out += (rng.getrandbits(32) & 0xFFFFF000 | rd << 7 | 0x6F).to_bytes(4, "little")
        elif k < 0.7:
            out += (rng.getrandbits(20) << 12 | rd << 7 | 0x17).to_bytes(4, "little")
            out += (rng.getrandbits(12) << 20 | rng.choice([rd, rng.getrandbits(5)]) << 15 | rng.getrandbits(8) << 7 | rng.choice([0x03, 0x13, 0x67])).to_bytes(4, "little")
        else:
            out += rng.randbytes(rng.choice([2, 4]))
    return bytes(out[:n])


def test_riscv_goes_both_ways_and_in_pieces():
    rng = random.Random(7)
    # a call at 0x1000 of 0x1010: the target is in the bytes, the highest first
    assert codecs.riscv((0x010000EF).to_bytes(4, "little") + bytes(8), True, 0x1000)[0][:4] == bytes([0xEF, 0x00, 0x08, 0x08])
    for _ in range(400):
        plain = riscv_code(rng, rng.randrange(200))
        coded = codecs.riscv(plain, True)[0]
        assert codecs.riscv(coded, False)[0] == plain and codecs.riscv(codecs.riscv(plain, False)[0], True)[0] == plain
        cuts = sorted(rng.randrange(len(coded) + 1) for _ in range(5))
        parts = [coded[a:b] for a, b in zip([0, *cuts], [*cuts, len(coded)], strict=True)]
        assert b"".join(streams.decoded("BCJ_RISCV", b"", iter(parts), len(plain))) == plain


def test_a_hosts_coder_stands_in():
    codecs.register("XOR", lambda p, d, n, w: bytes(x ^ p[0] for x in d), lambda d, o, w: (b"\x2a", bytes(x ^ 42 for x in d)), b"\xf0\x01")
    try:
        properties, packed = codecs.encode("XOR", b"some bytes")
        assert codecs.decode("XOR", properties, packed, 10) == b"some bytes" == b"".join(streams.decoded("XOR", properties, iter([packed]), 10))
    finally:
        codecs.register("XOR")
    with pytest.raises(ArchiveError):
        codecs.decode("XOR", b"", b"", 1)


def test_bcj2_in_a_folder():
    data = b"".join(b"\xe8" + k.to_bytes(4, "little", signed=True) + b"\x55\x90" for k in range(-300, 300))
    main, call, jump, coded = bcj2.encode(data)
    folder = {
        "coders": [{"method_id": codecs.IDS["BCJ2"], "num_in": 4, "num_out": 1, "properties": b""}, *({"method_id": codecs.IDS["COPY"], "num_in": 1, "num_out": 1, "properties": b""} for _ in range(3))],
        "bind_pairs": [{"in_index": 0, "out_index": 1}, {"in_index": 1, "out_index": 2}, {"in_index": 2, "out_index": 3}],
        "packed_streams": [4, 5, 6, 3], "unpack_sizes": [len(data), len(main), len(call), len(jump)],
    }
    assert header.decode_folder(folder, [main, call, jump, coded]) == data


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=50), max_size=6))
def test_crc_of_parts(parts):
    out = 0
    for p in parts:
        out = crc.combine(out, zlib.crc32(p), len(p))
    assert out == zlib.crc32(b"".join(parts))


def test_folding_needs_a_tiling(spark):
    data = random.Random(1).randbytes(1000)
    cut = lambda a, b: (a, b - a, zlib.crc32(data[a:b]))
    rows = [("good", *cut(a, a + 100)) for a in range(0, 1000, 100)] + [("gap", *cut(0, 100)), ("gap", *cut(200, 300))] + [("over", *cut(0, 200)), ("over", *cut(100, 300))] + [("null", 0, 5, None)]
    df = spark.createDataFrame(rows, "k string, offset long, len long, crc long").repartition(5)
    got = {r.k: r for r in integrity.fold(df, "k").collect()}
    assert got["good"].crc == zlib.crc32(data) and got["good"].len == 1000
    assert got["gap"].crc is None and got["over"].crc is None and got["null"].crc is None


def test_dictionaries_and_memory(spark):
    rows = [("LZMA2", bytes([p])) for p in (0, 1, 18, 40, 41)] + [("LZMA", bytes([93]) + (1 << 20).to_bytes(4, "little")), ("LZMA", b"\xff\0\0\0\0"), ("LZMA", b"\1"), ("COPY", b""), ("ZSTD", b""), ("LZS", b"")]
    df = spark.createDataFrame(rows, "m string, p binary")
    got = [r[0] for r in df.select(sizes.coder_memory(F.col("m"), F.col("p"))).collect()]
    mib = 1 << 20
    assert got == [4096 + mib, 6144 + mib, (2 << 20) + mib, (1 << 32) + mib, None, mib + mib, None, None, 0, 160 * mib, None]
    found = [r[0] for r in df.where("m = 'LZMA2'").select(sizes.lzma2_dictionary(F.col("p"))).collect()]
    assert found == [4096, 6144, 2 << 20, (1 << 32) - 1, None] and codecs.lzma2_dictionary(18) == 2 << 20


def test_method_names(spark):
    df = spark.createDataFrame([(bytes.fromhex(c),) for c in sizes.METHOD_IDS.values()] + [(b"zz",)], "id binary")
    assert [r[0] for r in df.select(sizes.method_name(F.col("id"))).collect()] == [*sizes.METHOD_IDS, None]


def test_exact_ratios_at_the_edge(spark):
    big = (1 << 63) - 1
    df = spark.createDataFrame([(big, 3, big // 3), (10, 5, 2), (11, 5, 2), (5, 0, 1)], "u long, p long, l long")
    got = df.select(sizes.unpack_ratio_exceeds(F.col("u"), F.col("p"), F.col("l")).alias("x"), sizes.unpack_ratio(F.col("u"), F.col("p")).alias("r"), sizes.end(F.col("u"), F.col("p")).alias("e")).collect()
    assert [r.x for r in got] == [True, False, True, False] and [r.r for r in got] == [-(-big // 3), 2, 3, 0] and got[0].e == big


def plan_brute(sizes_, threads, stage):
    out, run = [], []

    def close():
        nonlocal run
        workers = min(threads, len(run))
        if len(run) >= 2 and workers >= 2:
            out.append((run[0], run[-1], workers, max(1, threads // workers)))
        else:
            out.extend((b, b, 1, threads) for b in run)
        run = []

    for b, s in enumerate(sizes_):
        if s <= stage:
            run.append(b)
        else:
            close()
            out.append((b, b, 1, threads))
    close()
    return out


def test_plans_match_a_loop(spark):
    rng = random.Random(4)
    shapes = [[rng.randrange(20) for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    rows = [(a, b, s, 0) for a, shape in enumerate(shapes) for b, s in enumerate(shape)]
    df = spark.createDataFrame(rows, "archive_id long, block_index long, unpack_size long, memory long")
    got = {}
    for r in planner.plan_folders(df, 3, stage=9).orderBy("archive_id", "phase").collect():
        got.setdefault(r.archive_id, []).append((r.first_block, r.last_block, r.workers, r.threads_each))
    assert got == {a: plan_brute(shape, 3, 9) for a, shape in enumerate(shapes)}


def test_bench_details(spark):
    rows = spark.createDataFrame([("s1", "a", 0), ("s1", "b", 1), ("s1", "c", 2)], "scenario string, variant string, variant_index int")
    got = {(r["pass"], r.position): r.variant for r in benchstats.run_order(rows, 2).collect()}
    assert [got[0, i] for i in range(3)] == ["a", "b", "c"] and [got[1, i] for i in range(3)] == ["c", "b", "a"]
    plan = spark.createDataFrame([(["a", "b"], 3, 1), (["a"], 2, 0)], "variants array<string>, repeats int, warmups int")
    assert benchstats.process_count(plan).first()[0] == 10
    ids = spark.createDataFrame([("decode-x",), ("encode-y",)], "id string")
    assert [r.id for r in benchstats.only(ids, ["ode-x", "zzz"]).collect()] == ["decode-x"] and benchstats.only(ids, []).count() == 2
    threads = spark.createDataFrame([("all",), ("3",)], "t string").select(benchstats.resolve_threads(F.col("t"), F.lit(8))).collect()
    assert [r[0] for r in threads] == [8, 3]
    heads = benchstats.group_heads(spark.createDataFrame([("r", 1, "x"), ("r", 2, "x"), ("r", 3, "y")], "report string, o int, g string"), "o", "g").orderBy("o").collect()
    assert [(r.head, r.tail) for r in heads] == [(True, False), (False, True), (True, True)]
    cats = spark.createDataFrame([("decode", "a", 0, 1.0), ("decode", "b", 1, 9.0), ("decode", "c", 2, None), ("decode", "All decode", 3, 0.5), ("encode", "x", 1, 1.0), ("encode", "y", 0, 0.5)], "chart string, category string, first_seen int, mean double")
    bars = benchstats.chart_order(cats).orderBy("chart", "position").collect()
    assert [r.category for r in bars] == ["All decode", "b", "a", "c", "y", "x"]
    summary = spark.createDataFrame([("secondary", "s", "v", ["late"]), ("candidate", "s", "w", ["a", "b"])], "role string, scenario string, variant string, failures array<string>")
    assert sorted(map(tuple, benchstats.failures_by_role(summary).collect())) == [("primary", "s", "w", "a"), ("primary", "s", "w", "b"), ("secondary", "s", "v", "late")]


def test_chart_rules(spark):
    rows = [
        ("container parse", "list/st", "1", "Listing"), ("lzma2 parallel", "decode/mt", "all", "LZMA2, multi-thread"), ("lzma2 parallel", "decode/mt/stream", "1", "Streamed extract, 1 thread"),
        ("solid vs non-solid", "decode/tree_nonsolid", "4", "Non-solid trees, multi-thread"), ("encode", "encode/payload-sub/l5", "1", "LZMA2, 1 thread"), ("encode", "encode/tree/l5", "1", "Solid trees, 1 thread"),
        ("filters", "decode/delta", "1", "BCJ / BCJ2 / delta, 1 thread"), ("new", "decode/x", "2", "new, multi-thread"), ("container parse", "list/x/stream", "2", "Listing"),
    ]
    df = spark.createDataFrame(rows, "g string, s string, t string, want string")
    assert all(r[0] == r[1] for r in df.select(benchstats.category(F.col("g"), F.col("s"), F.col("t")), "want").collect())
    flags = spark.createDataFrame([("decode ledger", "decode", False, 0), ("memory budget", "decode", False, 0), ("lzma", "list", False, 0), ("lzma", "encode", True, 0), ("lzma", "encode", False, 7), ("lzma", "encode", None, None)], "g string, op string, a boolean, m long")
    got = flags.select(benchstats.excluded(F.col("g"), F.col("a"), F.col("m")), benchstats.headline(F.col("g"), F.col("op"), F.col("a"), F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(True, "All decode"), (True, None), (False, None), (True, None), (True, None), (False, "All encode")]


def test_means_need_every_host(spark):
    rows = [("h1", "c", "v", "s1", 2.0), ("h1", "c", "v", "s2", 8.0), ("h2", "c", "v", "s1", 1.0), ("h2", "c", "v", "s2", 1.0), ("h1", "d", "v", "s1", 3.0), ("h1", "e", "v", "s1", 3.0), ("h2", "e", "v", "s2", 3.0), ("h1", "f", "v", "s1", 3.0), ("h2", "f", "v", "s1", 0.0)]
    df = spark.createDataFrame(rows, "host string, category string, variant string, scenario string, wall double")
    got = benchstats.geomeans_by_category(df).collect()
    assert [(r.category, r.hosts, r.scenarios, round(r["mean"], 9)) for r in got] == [("c", 2, 2, 2.0)]
    more = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "host string")
    assert benchstats.geomeans_by_category(df, hosts=more).collect() == []
    common = {r.scenario: r.common for r in benchstats.common_scenarios(df.where("category = 'e' or scenario = 's1'")).collect()}
    assert common == {"s1": True, "s2": False}
    cells = spark.createDataFrame([("s", "v", "A", 1), ("s", "v", "B", 2), ("t", "v", "B", 3)], "scenario string, variant string, host string, wall long")
    assert sorted(map(tuple, benchstats.host_pivot(cells, ["A", "B"]).collect())) == [("s", "v", "1", "2"), ("t", "v", "-", "3")]


def test_folds_of_long_inputs(spark):
    n = 200_000
    entries = spark.range(n).select(F.lit("a").alias("archive_id"), F.col("id").alias("file_index"), (F.col("id") * 7919 % 1000).alias("size"))
    got = [r.bin for r in planner.solid_bins(entries, 5000).orderBy("file_index").collect()]
    held, at, want = 0, 0, []
    for i in range(n):
        size = i * 7919 % 1000
        held, at = (size, at + 1) if i and held + size >= 5000 else (held + size, at)
        want.append(at)
    assert got == want
    rng = random.Random(3)
    flags = [(k, i, rng.random() < 0.5) for k in ("x", "y") for i in range(300)]
    got = {(r.k, r.run_index): r.dense for r in planner.hysteresis(spark.createDataFrame(flags, "k string, run_index int, stored boolean"), ("k",)).collect()}
    state, streak = False, 0
    for k, i, f in flags:
        state, streak = (False, 0) if i == 0 else (state, streak)
        streak = 0 if f == state else streak + 1
        state, streak = (f, 0) if streak >= 2 else (state, streak)
        assert got[k, i] == state


def test_batches_of_chunks_close_as_a_stream_does(spark):
    from foldlake.streaming import runs

    rng = random.Random(9)
    rows, want = [], []
    for block in range(30):
        chunks, at = [], 0
        for i in range(rng.randrange(1, 20)):
            c = {"packed_offset": at, "control": 1, "packed_len": rng.randrange(1, 9), "unpacked_len": rng.randrange(1, 90), "is_reset": rng.random() < 0.3 or i == 0, "is_stored": rng.random() < 0.5}
            at += c["packed_len"]
            chunks.append(c)
        if rng.random() < 0.5:
            chunks.append({"packed_offset": at, "control": 0, "packed_len": 1, "unpacked_len": 0, "is_reset": False, "is_stored": False})
        _, closed = runs.advance(None, chunks)
        want += [("a", block, *r, r[4] > 0 and r[5] * 64 <= r[4], True) for r in closed]
        rows += [("a", block, *c.values()) for c in chunks]
    df = spark.createDataFrame(rows, "archive_id string, block_index long, packed_offset long, control int, packed_len long, unpacked_len long, is_reset boolean, is_stored boolean")
    assert sorted(map(tuple, runs.closed_runs(df).collect())) == sorted(want)


def test_generator_is_the_published_one(spark):
    rng = payload.SplitMix64(1234567)
    assert [rng.next() for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]
    assert payload.text(7, 1000) == payload.text(7, 1000) and len(payload.text(7, 1000)) == 1000
    rows = payload.tree(spark, 20, 400, 5).collect()
    assert len({r.name for r in rows}) == 20 and all(100 <= len(r.data) <= 700 for r in rows)


def test_table_functions(spark):
    udtfs.register(spark)
    files = [{"name": n, "has_stream": False} for n in ("a", "b")]
    head = header.write_header(0, [], [], [], [], files)
    start, tail = header.close(head, 0, compress=False)
    spark.createDataFrame([(start + tail,), (b"junk",)], "content binary").createOrReplaceTempView("values_of_archives")
    got = spark.sql("SELECT t.* FROM values_of_archives, LATERAL list_entries(content) t").collect()
    assert [r.name for r in got if r.error is None] == ["a", "b"] and [r.error for r in got if r.error] == ["BadSignature: not a 7z archive"]
    _, packed = codecs.encode("LZMA2", b"x" * 5000)
    spark.createDataFrame([(packed,)], "stream binary").createOrReplaceTempView("streams")
    assert [r.output_len for r in spark.sql("SELECT t.* FROM streams, LATERAL lzma2_runs(stream) t").collect()] == [5000]


def test_round_trip_in_slices(spark, monkeypatch):
    from foldlake.plans import codec_queries

    batch = pa.RecordBatch.from_pydict({"k": list(range(6)), "data": [b"a" * 5, b"", b"b" * 20, b"c", b"d" * 9, None]})
    cut = list(codec_queries._slices(iter([batch, batch.slice(0, 0), batch]), "data", 10))
    assert [p.num_rows for p in cut if p.num_rows] == [2, 1, 3, 2, 1, 3]
    assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist() * 2
    # what comes out of a task comes in pieces, not as one batch of all it read
    got = []
    monkeypatch.setattr(codec_queries, "SLICE", 1 << 16)
    monkeypatch.setattr(codec_queries.shipping, "ship", lambda spark: None)
    rows = SimpleNamespace(sparkSession=None, select=lambda *c: SimpleNamespace(mapInArrow=lambda run, schema: got.append(run)))
    codec_queries.round_trip(rows, "k", "data", codec_queries.CHAINS["zstd"])
    texts = [random.Random(i).randbytes(1000) for i in range(1000)]
    out = list(got[0](iter([pa.RecordBatch.from_pydict({"k": list(range(1000)), "data": texts})])))
    assert max(b.nbytes for b in out) < 1 << 17 and [t for b in out for t in b.column("decoded").to_pylist()] == texts
