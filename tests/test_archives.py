"""Archives end to end: write, list, decode, verify; damage, limits and passwords."""

import random
import struct
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foldlake.functions import codecs
from foldlake.functions.errors import ArchiveError
from foldlake.operators import catalog as derive
from foldlake.operators.limits import ArchiveLimits
from foldlake.sources import archives, header, run_scan, storage, writer

ROWS = "archive_id string, place long, name string, data binary, mtime_ticks decimal(20,0), windows_attributes long, is_directory boolean, block long"


def members(path, n=12):
    rng = random.Random(7)
    out = []
    for i in range(n):
        data = (f"member {i} ".encode() * rng.randrange(1, 400)) + rng.randbytes(rng.randrange(200))
        out.append((path, i, f"dir/f{i:03d}.txt", data, Decimal(133_000_000_000_000_000 + i), 0x8020 | 0o100644 << 16, False, i // 5))
    out.append((path, n, "dir", None, None, 0x10, True, n // 5))
    out.append((path, n + 1, "empty", None, None, None, False, n // 5))
    return out


def build(spark, path, methods=writer.DEFAULT, password=None, solid=False, rows=None, **how):
    df = spark.createDataFrame(rows if rows is not None else members(path), ROWS)
    return writer.assemble(writer.prepare(df, methods, password, solid), password, **how).collect()[0]


def decoded(cat, password=None, **how):
    out = {}
    for r in archives.contents(cat, password, **how).orderBy("file_index", "offset").collect():
        assert r.error is None, r.error
        out[r.name] = out.get(r.name, b"") + bytes(r.data)
    return out


@pytest.mark.parametrize("solid", [False, True])
def test_round_trip(spark, tmp_path, solid):
    path = str(tmp_path / "a.7z")
    rows = members(path)
    done = build(spark, path, solid=solid)
    assert done.n_entries == len(rows) and done.n_bytes == (tmp_path / "a.7z").stat().st_size
    assert not list(tmp_path.glob("*.part*")) and not list(tmp_path.glob("*.body"))
    cat = archives.catalog(spark, path)
    assert decoded(cat) == {r[2]: r[3] for r in rows if r[3] is not None}
    listed = {r.name: r for r in cat.entries.collect()}
    assert listed["dir"].is_directory and not listed["empty"].is_directory and not listed["empty"].has_stream
    assert listed["dir/f003.txt"].mtime_ticks == Decimal(133_000_000_000_000_003)
    assert listed["dir/f003.txt"].crc == zlib.crc32(rows[3][3])
    assert derive.solid(cat.blocks).first().is_solid == solid
    assert archives.integrity(cat).count() == 0
    offsets = derive.member_offsets(derive.file_blocks(cat.entries, cat.blocks).where("has_stream"))
    spans = {r.name: (r.block_index, r.unpacked_offset, r["size"]) for r in offsets.collect()}
    at = {}
    for r in rows:
        if r[3] is not None:
            block = spans[r[2]][0]
            assert spans[r[2]][1:] == (at.get(block, 0), len(r[3]))
            at[block] = at.get(block, 0) + len(r[3])


CHAINS = [
    [("COPY", codecs.Options())], [("LZMA", codecs.Options())], [("BZIP2", codecs.Options())], [("DEFLATE", codecs.Options())],
    [("ZSTD", codecs.Options())], [("LZ4", codecs.Options(frame=4096))], [("BROTLI", codecs.Options(frame=4096))],
    [("BCJ_X86", codecs.Options()), ("LZMA2", codecs.Options())], [("DELTA", codecs.Options(distance=4)), ("LZMA", codecs.Options())],
    [("BCJ_ARM64", codecs.Options()), ("LZMA2", codecs.Options())],
    [("LZMA2", codecs.Options()), ("AES256_SHA256", codecs.Options(power=8, salt=b"salt"))],
]


def test_all_methods_in_one_scan(spark, tmp_path):
    for i, chain in enumerate(CHAINS):
        secret = "pässword" if chain[-1][0] == "AES256_SHA256" else None
        build(spark, str(tmp_path / f"{i:02d}.7z"), chain, secret, rows=members(str(tmp_path / f"{i:02d}.7z"), 3), encrypt_header=False)
    cat = archives.catalog(spark, str(tmp_path), password="pässword")
    assert cat.errors.count() == 0
    got = archives.contents(cat, "pässword").collect()
    assert all(r.error is None for r in got)
    want = {r[2]: r[3] for r in members("", 3) if r[3] is not None}
    assert len(got) == 3 * len(CHAINS) and all(bytes(r.data) == want[r.name] for r in got)
    methods = {tuple(r.methods) for r in derive.methods_of(derive.file_blocks(cat.entries, cat.blocks), cat.coders).collect()}
    assert methods == {tuple(m for m, _ in c) for c in CHAINS}


def test_encrypted_header_needs_the_password(spark, tmp_path):
    path = str(tmp_path / "e.7z")
    build(spark, path, [("COPY", codecs.Options()), ("AES256_SHA256", codecs.Options(power=6))], "secret", rows=members(path, 2))
    assert archives.catalog(spark, path).errors.first().code == "PasswordRequired"
    assert archives.catalog(spark, path, password="wrong").errors.count() == 1
    cat = archives.catalog(spark, path, password="secret")
    assert len(decoded(cat, "secret")) == 2
    wrong = archives.contents(cat, "other").collect()
    assert {r.error.split(":")[0] for r in wrong if r.error} == {"Password"} and {r.block_index for r in wrong if r.error} == {0, 1}


def test_damage_is_a_value(spark, tmp_path):
    path = tmp_path / "d.7z"
    build(spark, str(path), [("COPY", codecs.Options())], rows=members(str(path), 4))
    data = bytearray(path.read_bytes())
    data[40] ^= 1
    path.write_bytes(data)
    cat = archives.catalog(spark, str(path))
    rows = archives.contents(cat).collect()
    assert {r.error.split(":")[0] for r in rows if r.error} == {"ChecksumMismatch"} and len([r for r in rows if not r.error]) == 3
    assert {r.block_index for r in rows if r.error} == {0}
    assert archives.integrity(cat).count() == 1
    assert all(r.error is None for r in archives.contents(cat, verify=False).collect())


def test_every_cut_and_flip_of_a_header_is_an_error_or_a_listing(spark, tmp_path):
    path = tmp_path / "h.7z"
    build(spark, str(path), rows=members(str(path), 3), compress_header=False)
    data = path.read_bytes()
    limits = ArchiveLimits()
    for cut in range(0, len(data), 3):
        part = data[:cut]
        with pytest.raises(ArchiveError):
            header.parse(lambda o, n: part[o : o + n], len(part), limits)  # noqa: B023
    offset, size = struct.unpack_from("<QQ", data, 12)
    head = data[32 + offset : 32 + offset + size]
    rng = random.Random(3)
    for _ in range(600):
        bad = bytearray(head)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        fields = struct.pack("<QQI", offset, size, zlib.crc32(bad))
        whole = data[:8] + struct.pack("<I", zlib.crc32(fields)) + fields + data[32 : 32 + offset] + bytes(bad)
        try:
            header.parse(lambda o, n: whole[o : o + n], len(whole), limits)  # noqa: B023
        except ArchiveError:
            pass


def _raw(head: bytes) -> bytes:
    fields = struct.pack("<QQI", 0, len(head), zlib.crc32(head))
    return header.SIGNATURE + b"\0\4" + struct.pack("<I", zlib.crc32(fields)) + fields + head


def _parse(data: bytes, **limits):
    return header.parse(lambda o, n: data[o : o + n], len(data), ArchiveLimits(**limits))


def _files(*names):
    files = [{"name": n, "has_stream": False, "is_directory": False} for n in names]
    return _raw(header.write_header(0, [], [], [], [], files))


@pytest.mark.parametrize(
    ("make", "limits", "limit"),
    [
        (lambda: _files("a", "b", "c"), {"max_entries": 2}, "Entries"),
        (lambda: _files("a" * 50), {"max_name_bytes": 40}, "NameBytes"),
        (lambda: _files("a" * 50), {"max_names_bytes": 40}, "NamesBytes"),
        (lambda: _files("a"), {"max_header_bytes": 4}, "HeaderBytes"),
        (lambda: _files("a"), {"archive_bytes": 40}, "ArchiveBytes"),
        (lambda: _files("ok", "../x"), {"reject_unsafe_names": True}, "UnsafeEntryName"),
    ],
)
def test_limits(make, limits, limit):
    with pytest.raises(ArchiveError) as e:
        _parse(make(), **limits)
    assert e.value.code == "LimitExceeded" and e.value.limit == limit
    _parse(make())


def test_empty_archives_and_header_contracts(spark, tmp_path):
    empty = header.SIGNATURE + b"\0\4" + writer._empty()
    with pytest.raises(ArchiveError):  # all zeros mean a lost header, and there is none to find
        _parse(empty + b"\0" * 32 if zlib.crc32(bytes(20)) == 0 else header.SIGNATURE + b"\0\4" + bytes(24))
    assert _parse(empty).files == []
    with pytest.raises(ArchiveError):
        _parse(header.SIGNATURE + b"\1\4" + bytes(24))
    offset = struct.pack("<QQI", 5, 0, 0)
    with pytest.raises(ArchiveError):
        _parse(header.SIGNATURE + b"\0\4" + struct.pack("<I", zlib.crc32(offset)) + offset + bytes(10))
    names = [f.name if hasattr(f, "name") else f["name"] for f in _parse(_files("dup", "dup", "ünï\U0001f600")).files]
    assert names == ["dup", "dup", "ünï\U0001f600"]


def test_recovers_a_lost_start_header():
    lost = header.SIGNATURE + b"\0\4" + bytes(24) + b"some packed bytes"
    # no byte behind the first one could begin a header
    head = header.write_header(0, [], [], [], [], [{"name": "x", "has_stream": False}] * 9)
    assert not set(head[1:]) & {1, 0x17}
    assert [f["name"] for f in _parse(lost + head).files] == ["x"] * 9
    # here a size of 1 could, and what follows it is none: the search ends there
    with pytest.raises(ArchiveError, match="Corrupted"):
        _parse(lost + header.write_header(0, [], [], [], [], [{"name": "x", "has_stream": False}]))
    # one that is longer than a header may be isn't tried
    with pytest.raises(ArchiveError) as e:
        _parse(lost + head, max_header_bytes=8)
    assert e.value.limit == "HeaderBytes"


def test_numbers():
    for x in [0, 1, 127, 128, 16383, 16384, (1 << 35) - 1, 1 << 35, (1 << 56) - 1, 1 << 56, (1 << 64) - 1]:
        data = header.number(x)
        assert header.Reader(data).number() == x
        assert len(data) == min(9, max(1, -(-x.bit_length() // 7)))


def test_raw_copy_renames_without_touching_packed_bytes(spark, tmp_path):
    source, target = str(tmp_path / "s.7z"), str(tmp_path / "t.7z")
    rows = members(source, 4)[:4]
    build(spark, source, rows=rows)
    cat = archives.catalog(spark, source)
    copied = writer.copy_blocks(cat, F.concat(F.lit("new/"), "name")).withColumn("archive_id", F.lit(target))
    writer.assemble(copied).collect()
    other = archives.catalog(spark, target)
    assert decoded(other) == {f"new/{r[2]}": r[3] for r in rows}
    n = cat.pack_streams.agg(F.sum("size")).first()[0]
    assert (tmp_path / "s.7z").read_bytes()[32 : 32 + n] == (tmp_path / "t.7z").read_bytes()[32 : 32 + n]


def test_bcj2_archives_round_trip(spark, tmp_path):
    path, rng = str(tmp_path / "b.7z"), random.Random(4)
    code = b"".join(rng.choice([b"\xe8", b"\xe9", b"\x0f\x84"]) + rng.randrange(5000).to_bytes(4, "little") + rng.randbytes(3) for _ in range(400))
    rows = [(path, i, f"m{i}", d, None, None, False, 0) for i, d in enumerate([code, b"", b"plain", code[:77], b"\xe8"])]
    build(spark, path, rows=rows, methods=[("BCJ2", codecs.Options()), ("LZMA2", codecs.Options(level=1))])
    cat = archives.catalog(spark, path)
    assert decoded(cat) == {r[2]: r[3] for r in rows}
    assert {len(r.coders) for r in cat.blocks.collect()} == {4} and cat.blocks.first().packed_streams == [4, 5, 6, 3]
    again = str(tmp_path / "s.7z")
    df = spark.createDataFrame([(again, i, r[2], r[3], 0) for i, r in enumerate(rows)], "archive_id string, place long, name string, data binary, block int")
    writer.assemble(writer.prepare(df, [("BCJ2", codecs.Options()), ("COPY", codecs.Options())], solid=True)).collect()
    assert decoded(archives.catalog(spark, again)) == {r[2]: r[3] for r in rows}


def test_lookup_by_name_gives_the_last(spark, tmp_path):
    path = str(tmp_path / "n.7z")
    rows = [(path, i, "same", f"v{i}".encode(), None, None, False, 0) for i in range(3)]
    build(spark, path, rows=rows)
    cat = archives.catalog(spark, path)
    assert cat.entries.count() == 3
    assert [bytes(r.data) for r in archives.read_file(cat, "same").collect()] == [b"v2"]


def test_volumes_read_as_one(spark, tmp_path):
    path = str(tmp_path / "v.7z")
    rows = members(path, 5)
    build(spark, path, rows=rows)
    data = (tmp_path / "v.7z").read_bytes()
    parts = []
    for i in range(0, len(data), 500):
        parts.append(str(tmp_path / f"v.7z.{i // 500 + 1:03d}"))
        storage.write_whole(parts[-1], [data[i : i + 500]])
    volumes = {path: parts}
    cat = archives.catalog(spark, path, volumes=volumes)
    assert decoded(cat, volumes=volumes) == {r[2]: r[3] for r in rows if r[3] is not None}


def test_long_members_come_in_chunks(spark, tmp_path):
    path = str(tmp_path / "c.7z")
    data = random.Random(1).randbytes(10_000)
    build(spark, path, rows=[(path, 0, "big", data, None, None, False, 0)])
    cat = archives.catalog(spark, path)
    rows = archives.contents(cat, chunk=1000).orderBy("offset").collect()
    assert [r.offset for r in rows] == list(range(0, 10_000, 1000))
    assert b"".join(bytes(r.data) for r in rows) == data and [r.crc32 for r in rows] == [zlib.crc32(data[: r.offset + 1000]) for r in rows]


def test_bad_chains_are_refused():
    for methods in ([], [("BCJ2", codecs.Options())], [("AES256_SHA256", codecs.Options()), ("LZMA2", codecs.Options())]):
        with pytest.raises(ArchiveError):
            writer.check_methods(methods)


def test_blocks_decode_by_their_runs(spark, tmp_path):
    path = str(tmp_path / "runs.7z")
    rng = random.Random(8)
    rows = [(path, i, f"m{i}", rng.randbytes(300) * rng.randrange(1, 200), None, None, False, 0) for i in range(30)]
    rows[7] = (path, 7, "m7", b"", None, None, False, 0)
    build(spark, path, [("LZMA2", codecs.Options(level=1, dictionary=4096, chunk=50_000))], solid=True, rows=rows)
    cat = archives.catalog(spark, path)
    found = run_scan.runs(run_scan.plan(cat)).collect()
    assert len(found) > 10 and sum(r.output_len for r in found) == sum(len(r[3]) for r in rows)
    pieces = run_scan.contents(cat, chunk=7000)
    got = {}
    for r in pieces.orderBy("file_index", "offset").collect():
        assert r.error is None and r.offset == len(got.get(r.name, b""))
        got[r.name] = got.get(r.name, b"") + bytes(r.data)
    assert got == {r[2]: r[3] for r in rows} == decoded(cat)
    assert run_scan.verified(cat, pieces).count() == 0
    data = bytearray((tmp_path / "runs.7z").read_bytes())
    data[found[3].packed_at] = 0x55  # no control byte of a chunk
    (tmp_path / "runs.7z").write_bytes(data)
    errors = run_scan.contents(archives.catalog(spark, path)).where("error is not null").collect()
    assert errors and all(e.error.startswith("Corrupted") for e in errors)


def test_solid_block_by_runs(spark, tmp_path):
    """Encoded and decoded run by run, a block is what it is as a whole; no row grows with the block."""
    from foldlake.sources import in_memory

    rng = random.Random(9)
    methods = [("LZMA2", codecs.Options(level=1, dictionary=4096, chunk=10_000))]
    sizes = {"long": [25_000, 0, 10_000, 0, 0, 5, *[300] * 200, 40_000, 10_000, 0], "one": [12_345], "small": [7], "empty": [0, 0], "none": [0]}
    members = {k: [(f"{k}{i}", rng.randbytes(n // 5 + 1) * 5) for i, n in enumerate(ns)] for k, ns in sizes.items()}
    members = {k: [(name, data[:n]) for (name, data), n in zip(m, sizes[k], strict=True)] for k, m in members.items()}
    rows = [(str(tmp_path / f"{k}.7z"), i, name, None if k == "none" else data, 0) for k, m in members.items() for i, (name, data) in enumerate(m)]
    rng.shuffle(rows)
    parts = writer.prepare(spark.createDataFrame(rows, "archive_id string, place long, name string, data binary, block int"), methods, solid=True)
    assert max(r.n for r in parts.selectExpr("octet_length(packed) n").collect()) < 15_000
    made = {r.archive_id: r.n_blocks for r in writer.assemble(parts).collect()}
    assert sorted(made.values()) == [0, 1, 1, 1, 1]
    for k, m in members.items():
        if k != "none":
            assert (tmp_path / f"{k}.7z").read_bytes() == in_memory.pack(m, methods, solid=True), k
    cat = archives.catalog(spark, sorted(made))
    found = run_scan.contents(cat).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.name, r.offset)):
        assert r.error is None and r.offset == len(got.get(r.name, b""))
        got[r.name] = got.get(r.name, b"") + bytes(r.data)
    assert got == {name: data for k, m in members.items() if k != "none" for name, data in m}
    assert len(found) == len({(r.name, r.offset) for r in found})
    block = run_scan.plan(cat).where(F.col("archive_id").endswith("long.7z"))
    facts = block.select("archive_id", "block_index", "unpack_size")
    placed = block.select("archive_id", "block_index", F.explode("members").alias("m")).select("archive_id", "block_index", "m.file_index", "m.name", "m.size")
    placed = derive.member_offsets(placed).withColumnRenamed("unpacked_offset", "at").join(facts, ["archive_id", "block_index"])
    held = {r.run_index: [m.name for m in r.members] for r in run_scan._with_members(run_scan.runs(block), placed).collect()}
    assert len(held) > 10 and sum(map(len, held.values())) <= len(members["long"]) + len(held)


def test_file_blocks_has_no_quadratic_frame(spark):
    """A frame up to the partition's end is worked out anew for each row."""
    entries = spark.range(40).selectExpr("'a' archive_id", "id file_index", "id % 7 not in (0, 3) has_stream")
    blocks = spark.range(3).selectExpr("'a' archive_id", "id block_index", "id * 5 + 4 num_sub_streams")
    mapped = derive.file_blocks(entries, blocks)
    assert "unboundedfollowing" not in mapped._jdf.queryExecution().toString().lower()
    streams = [b for b in range(3) for _ in range(b * 5 + 4)]
    owned, k = [], 0
    for i in range(40):
        there = i % 7 not in (0, 3) and k < len(streams)
        owned.append(streams[k] if there else None)
        k += i % 7 not in (0, 3)
    before = [next((b for b in reversed(owned[: i + 1]) if b is not None), None) for i in range(40)]
    after = [next((b for b in owned[i:] if b is not None), None) for i in range(40)]
    want = [b if b == a else None for b, a in zip(before, after, strict=True)]
    assert [r.block_index for r in mapped.orderBy("file_index").collect()] == want
