"""The data source, streams of runs, and files on disk."""

import os
import random
from decimal import Decimal

import pytest

from foldlake.functions import codecs, lzma2
from foldlake.functions.errors import ArchiveError
from foldlake.operators import planner
from foldlake.operators.limits import ArchiveLimits
from foldlake.sources import archives, datasource, files, in_memory, run_scan, storage, walks, writer
from foldlake.streaming import completions, runs


@pytest.fixture(scope="module")
def source(spark):
    datasource.register(spark)
    return spark


def rows(n=20):
    rng = random.Random(5)
    return [(f"d/{i:02d}.bin", rng.randbytes(rng.randrange(1, 3000)) * 2) for i in range(n)]


@pytest.mark.parametrize("solid", [0, 20_000])
def test_write_and_read(source, tmp_path, solid):
    path = str(tmp_path / "x.7z")
    want = dict(rows())
    df = source.createDataFrame(rows(), "name string, data binary").repartition(3)
    df.write.format("7z").option("method", "DELTA,LZMA2").option("solidBytes", str(solid)).mode("append").save(path)
    assert os.listdir(tmp_path) == ["x.7z"]
    read = lambda t, **o: source.read.format("7z").option("table", t).options(**o).load(path)
    assert {r.name: r["size"] for r in read("entries").collect()} == {k: len(v) for k, v in want.items()}
    assert {r.name: bytes(r.data) for r in read("contents").collect()} == want
    assert read("archives").first().major == 0 and read("coders").where("method = 'DELTA'").count() == read("blocks").count()
    assert (read("blocks").count() < 20) == bool(solid)
    assert read("sub_streams").count() == 20 and read("pack_streams").count() == read("blocks").count()
    name = rows()[3][0]
    assert {r.name for r in read("contents", names=name).collect()} == {name}
    assert {r.block_index for r in read("contents", blockIndex="1,2").collect()} == {1, 2}


def test_filters_prune_blocks(spark, tmp_path):
    path = str(tmp_path / "f.7z")
    writer.assemble(writer.prepare(spark.createDataFrame([(path, i, n, d) for i, (n, d) in enumerate(rows(6))], "archive_id string, place long, name string, data binary"))).collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        datasource.register(spark)
        df = spark.read.format("7z").option("table", "contents").load(path).where("block_index = 2")
        assert df.rdd.getNumPartitions() == 1 and [r.block_index for r in df.collect()] == [2]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        datasource.register(spark)


def test_secrets_come_from_the_environment(source, tmp_path, monkeypatch):
    monkeypatch.setenv("FOLDLAKE_TEST_WORD", "pw")
    path = str(tmp_path / "s.7z")
    df = spark_rows = source.createDataFrame(rows(2), "name string, data binary").coalesce(1)
    options = {"passwordVariable": "FOLDLAKE_TEST_WORD"}
    writer.assemble(writer.prepare(spark_rows.selectExpr(f"'{path}' as archive_id", "0L as place", "name", "data"), [("COPY", codecs.Options()), ("AES256_SHA256", codecs.Options(power=5))], "pw"), "pw").collect()
    cat = archives.catalog(source, path, password="pw")
    assert {r.name: bytes(r.data) for r in archives.contents(cat, "pw").collect()} == dict(rows(2))
    assert "pw" not in df._jdf.queryExecution().toString() and options["passwordVariable"] != "pw"


def stream_of(n=6, seed=2):
    """An LZMA2 stream of several runs, each of which begins with a reset."""
    rng = random.Random(seed)
    parts, plain = [], []
    for _ in range(n):
        data = (rng.randbytes(500) * rng.randrange(1, 400)) if rng.random() < 0.7 else rng.randbytes(90_000)
        _, packed = codecs.encode("LZMA2", data, codecs.Options(level=1))
        parts.append(packed[:-1])
        plain.append(data)
    return b"".join(parts) + b"\0", plain


def test_runs_are_found_and_decode_alone(spark):
    packed, plain = stream_of()
    found = lzma2.scan(spark.createDataFrame([("a", 0, packed)], "archive_id string, block_index long, packed binary"))
    shapes = planner.run_shapes(found).orderBy("run_index").collect()
    assert [s.unpacked for s in shapes] == [len(p) for p in plain]
    state, closed = runs.advance(None, list(lzma2.chunks(packed)))
    assert state is None and len(closed) == len(plain)
    for r, p in zip(closed, plain, strict=True):
        assert lzma2.decode_run(packed[r[1] : r[1] + r[2]], r[4]) == p


def test_a_growing_stream_closes_the_same_runs(source, tmp_path):
    packed, plain = stream_of(5, 3)
    path = tmp_path / "grow.lzma2"
    path.write_bytes(packed[:10])
    chunks = source.readStream.format("7z").option("table", "chunks").option("path", str(path)).load()
    q = runs.closed_runs(chunks).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for cut in (len(packed) // 3, len(packed) // 2, len(packed)):
            q.processAllAvailable()
            path.write_bytes(packed[:cut])
        q.processAllAvailable()
        got = sorted((r.run_index, r.packed_offset, r.packed_size, r.output_offset, r.output_len) for r in source.table("closed").collect())
    finally:
        q.stop()
    assert got == [r[:5] for r in runs.advance(None, list(lzma2.chunks(packed)))[1]]
    assert [r[4] for r in got] == [len(p) for p in plain]


def test_published_completions_stream_as_they_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("user_id as archive_id", "event_id as block_index", "event_type <> 'error' as verified")
    events.repartition(4).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    q = completions.published(stream).writeStream.format("memory").queryName("published").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("published").collect())) == sorted(map(tuple, completions.published(events).collect()))


def test_publish_takes_the_last_epoch(spark):
    found = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 0, 2), ("a", 1, 0, 1), ("b", 0, 0, 1)], "archive_id string, block_index long, run_index long, epoch int")
    folders = spark.createDataFrame([("a", 0, True, 2), ("a", 1, False, 1), ("b", 0, True, 1)], "archive_id string, block_index long, verified boolean, epoch int")
    assert sorted((r.archive_id, r.epoch) for r in runs.publish(found, folders).collect()) == [("a", 2), ("b", 1)]


def test_files_in_and_out(spark, tmp_path):
    root = tmp_path / "in"
    for name, data in {"a.txt": b"one", "sub/b.txt": b"two" * 1000, "sub/skip/c.txt": b"no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    path = str(tmp_path / "out.7z")
    found = files.walk(spark, str(root), path, keep=lambda p: ~p.endswith("skip"))
    writer.assemble(writer.prepare(found)).collect()
    cat = archives.catalog(spark, path)
    assert [r.name for r in cat.entries.orderBy("file_index").collect()] == ["a.txt", "sub/b.txt"]
    target = tmp_path / "x"
    target.mkdir()
    done = files.extract(archives.contents(cat, chunk=700), str(target)).collect()
    assert {r.error for r in done} == {None} and (target / "sub/b.txt").read_bytes() == b"two" * 1000
    assert sorted(p.name for p in target.rglob("*") if p.is_file()) == ["a.txt", "b.txt"]


def test_a_walk_takes_times_along(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a b.txt").write_bytes(b"x")
    at = 1_600_000_000_123_456_700
    os.utime(root / "a b.txt", ns=(at, at + 5_000_000_000))
    path = str(tmp_path / "o.7z")
    writer.assemble(writer.prepare(files.walk(spark, str(root), path, stat=True))).collect()
    r = archives.catalog(spark, path).entries.first()
    assert r.name == "a b.txt" and int(r.atime_ticks) >= at // 100 + files.EPOCH_TICKS
    assert abs(int(r.mtime_ticks) - (at + 5_000_000_000) // 100 - files.EPOCH_TICKS) < 10_000


def test_extraction_is_confined(spark, tmp_path):
    path = str(tmp_path / "evil.7z")
    names = ["../up", "/abs", "ok", "link/x", "C:/d"]
    df = spark.createDataFrame([(path, i, n, b"z") for i, n in enumerate(names)], "archive_id string, place long, name string, data binary")
    writer.assemble(writer.prepare(df)).collect()
    target = tmp_path / "t"
    target.mkdir()
    (target / "link").symlink_to(tmp_path)
    done = {r.name: r.error for r in files.extract(archives.contents(archives.catalog(spark, path)), str(target)).collect()}
    assert done["ok"] is None and all(done[n] for n in names if n != "ok")
    assert not (tmp_path / "up").exists() and not (tmp_path / "x").exists()


def _archive(spark, path, found, solid=0):
    df = spark.createDataFrame([(path, i, n, d, solid) for i, (n, d) in enumerate(found)], "archive_id string, place long, name string, data binary, block int")
    writer.assemble(writer.prepare(df, solid=bool(solid))).collect()
    return archives.catalog(spark, path)


def test_extraction_sets_times_and_keeps_the_last_of_equal_names(spark, tmp_path):
    path, ticks = str(tmp_path / "t.7z"), 133_000_000_000_000_000
    rows = [(path, 0, "same", b"old", ticks, False), (path, 1, "dir", None, None, True), (path, 2, "./same", b"new" * 1000, ticks + 10_000_000, False), (path, 3, "dir/empty", None, ticks, False)]
    df = spark.createDataFrame([(a, p, n, d, Decimal(m) if m else None, None, f) for a, p, n, d, m, f in rows], "archive_id string, place long, name string, data binary, mtime_ticks decimal(20,0), windows_attributes long, is_directory boolean")
    writer.assemble(writer.prepare(df)).collect()
    cat = archives.catalog(spark, path)
    target = tmp_path / "x"
    target.mkdir()
    done = files.extract(archives.contents(cat, chunk=700), str(target), cat.entries).collect()
    assert {r.error for r in done} == {None} and len(done) == 4
    assert (target / "same").read_bytes() == b"new" * 1000 and (target / "dir").is_dir() and (target / "dir/empty").read_bytes() == b""
    assert (target / "same").stat().st_mtime_ns == (ticks + 10_000_000 - files.EPOCH_TICKS) * 100
    assert (target / "dir/empty").stat().st_mtime_ns == (ticks - files.EPOCH_TICKS) * 100
    cat.close()


def test_walks_call_for_each_member(spark, tmp_path):
    path = str(tmp_path / "w.7z")
    found = [(f"m{i}", bytes([65 + i]) * (1000 * i + 1)) for i in range(6)]
    df = spark.createDataFrame([(path, i, n, d, i // 3) for i, (n, d) in enumerate(found)], "archive_id string, place long, name string, data binary, block int")
    writer.assemble(writer.prepare(df, solid=True)).collect()
    cat = archives.catalog(spark, path)
    out = tmp_path / "seen"
    out.mkdir()

    def each(entry, reader):
        (out / entry["name"]).write_bytes(reader.read(10) if entry["name"] == "m4" else reader.read())
        return entry["name"] != "m1"

    got = {(r.name, r.event) for r in walks.each(cat, each).collect()}
    # the first block ends with m1, the second is whole
    assert got == {("m0", "entry"), ("m1", "stopped"), ("m3", "entry"), ("m4", "entry"), ("m5", "entry"), (None, "block")}
    assert (out / "m4").read_bytes() == b"E" * 10 and (out / "m5").read_bytes() == found[5][1]

    def fails(entry, reader):
        raise ValueError("no")

    assert {(r.event, r.error) for r in walks.each(cat, fails).collect()} == {("failed", "Callback: no")}
    assert walks.each(cat, lambda entry, reader: False, ordered=False).count() >= 1
    target = tmp_path / "ex"
    target.mkdir()
    walks.extract_with(cat, str(target)).collect()
    assert {p.name: p.read_bytes() for p in target.iterdir()} == dict(found)


def test_a_walk_can_be_cancelled(spark, tmp_path):
    import threading
    import time

    cat = _archive(spark, str(tmp_path / "c.7z"), [("a", b"x")])
    cat.entries.count()

    def slow(entry, reader):
        time.sleep(60)

    start = time.time()
    with pytest.raises(ArchiveError, match="Cancelled"), walks.cancellable(spark) as cancel:
        threading.Timer(3, cancel).start()
        walks.each(cat, slow).collect()
    assert time.time() - start < 50


def test_archives_as_values(spark):
    found = [("a", b"one" * 500), ("b/c", b""), ("d", bytes(range(256)) * 40)]
    for solid in (False, True):
        for methods in (writer.DEFAULT, [("BCJ2", codecs.Options()), ("LZMA2", codecs.Options())]):
            assert sorted(in_memory.unpack(in_memory.pack(found, methods, solid=solid))) == sorted(found)
    assert list(in_memory.unpack(in_memory.pack([]))) == []
    assert list(in_memory.unpack(in_memory.pack(found[:1], [("LZMA2", codecs.Options()), ("AES256_SHA256", codecs.Options(power=5))], "pw"), "pw")) == found[:1]
    with pytest.raises(ArchiveError) as e:
        list(in_memory.unpack(in_memory.pack([("big", bytes(5000))]), limits=ArchiveLimits(max_unpack_bytes=4000)))
    assert e.value.limit == "UnpackBytes"
    with pytest.raises(ArchiveError):
        list(in_memory.unpack(in_memory.pack([("../up", b"x")])))


def test_single_runs_are_told_from_headers(spark, tmp_path):
    packed, plain = stream_of()
    read = lambda data: lambda at, n: data[at : at + n]
    total = sum(map(len, plain))
    assert not run_scan.is_single_run(read(packed), 0, len(packed), total)
    _, one = codecs.encode("LZMA2", b"abc" * 200_000, codecs.Options(level=1))
    assert run_scan.is_single_run(read(b"xx" + one), 2, len(one), 600_000)
    assert not run_scan.is_single_run(read(one), 0, len(one), 600_001) and not run_scan.is_single_run(read(one[:-1]), 0, len(one) - 1, 600_000)
    assert not run_scan.is_single_run(read(one), 0, len(one), 600_000, most=1) and not run_scan.is_single_run(read(b""), 0, 0, 0)
    cat = _archive(spark, str(tmp_path / "r.7z"), [("a", b"abc" * 100_000), ("b", b"")])
    assert [r.single for r in run_scan.single_runs(run_scan.plan(cat)).collect() if r.block_index == 0] == [True]


def test_folders_of_archives_and_shares_of_blocks(source, tmp_path):
    found = rows(40)
    path = str(tmp_path / "folder")
    df = source.createDataFrame([(n, d) for n, d in found], "name string, data binary").repartition(3)
    df.write.format("7z").option("method", "LZMA2").mode("append").save(path)
    names = sorted(p.name for p in (tmp_path / "folder").rglob("*"))
    assert 1 <= len(names) <= 3 and all(n.endswith(".7z") for n in names)
    read = lambda **o: source.read.format("7z").option("table", "contents").options(**o).load(path)
    for options in ({}, {"splitBytes": "200"}):
        assert {r.name: bytes(r.data) for r in read(**options).collect()} == dict(found)
    df.limit(5).write.format("7z").mode("overwrite").save(path)
    assert read().select("name").distinct().count() == 5


def test_a_streams_batch_is_bounded(tmp_path):
    packed, plain = stream_of(8, 5)
    path = tmp_path / "s.lzma2"
    path.write_bytes(packed)
    reader = datasource.ChunkStream({"path": str(path), "maxbytes": "1"})
    at, seen, batches = reader.initialOffset(), [], 0
    while not at["done"]:
        got, end = reader.read(at)
        got = list(got)
        assert list(reader.readBetweenOffsets(at, end)) == got
        assert end["at"] - at["at"] <= reader.most
        seen, at, batches = seen + got, end, batches + 1
    assert [r[2:] for r in seen] == [tuple(c[n] for n in lzma2.CHUNKS.fieldNames()[2:]) for c in lzma2.chunks(packed)]


def test_schemes_of_hadoop_are_known(monkeypatch):
    seen = []
    known = type("Known", (), {"from_uri": staticmethod(lambda uri: seen.append(uri) or (None, uri))})
    monkeypatch.setattr(storage.fs, "FileSystem", known)
    storage.resolve("s3a://bucket/key")
    storage.resolve("hdfs://nn/key")
    assert seen == ["s3://bucket/key", "hdfs://nn/key"]
