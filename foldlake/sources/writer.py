"""DataFrames to archives.

Encoding is a map: rows become prepared blocks on the executors (one row a block, or the rows of a
group in order as one solid block). Only assembling has an order, and it copies packed bytes: blocks
are sorted by their place within the archive and appended by one task for each archive, which then writes the header. An
archive is written beside its place and moved there whole, so a failed write leaves none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foldlake.functions import codecs
from foldlake.functions.crc import combine
from foldlake.functions.errors import ArchiveError
from foldlake.schemas import MEMBER, PARTS, PREPARED
from foldlake.sources import header, shipping, storage

Methods = list[tuple[str, codecs.Options]]
DEFAULT: Methods = [("LZMA2", codecs.Options())]


def check_methods(methods: Methods) -> None:
    names = [m for m, _ in methods]
    if not names:
        raise ArchiveError("InvalidArgument", "a block needs a method")
    if "BCJ2" in names and (names[0] != "BCJ2" or len(names) != 2 or names[1] in ("BCJ2", "AES256_SHA256")):
        raise ArchiveError("InvalidArgument", "BCJ2 has several streams: it comes first, with one method for the main one")
    if "AES256_SHA256" in names[:-1]:
        raise ArchiveError("InvalidArgument", "encryption comes last")


def _prepare(archive: str, place: int, rows: list[dict], methods: Methods, password: str | None) -> dict:
    members, plain, crc = [], [], 0
    for r in rows:
        data = r["data"]
        stream = data is not None and not r.get("is_directory")
        data = data or b""
        own = zlib.crc32(data) if stream else None
        members.append({
            "name": r["name"], "size": len(data), "crc": own, "ctime_ticks": r.get("ctime_ticks"), "atime_ticks": r.get("atime_ticks"), "mtime_ticks": r.get("mtime_ticks"), "windows_attributes": r.get("windows_attributes"),
            "has_stream": stream, "is_directory": bool(r.get("is_directory")),
        })
        if stream:
            plain.append(data)
            crc = combine(crc, own, len(data))
    whole, sizes = b"".join(plain), None
    if plain and methods[0][0] == "BCJ2":
        coders, streams = codecs.encode_bcj2(methods, whole, password)
        packed, sizes = b"".join(streams), [len(s) for s in streams]
    elif plain:
        coders, packed = codecs.encode_chain(methods, whole, password)
    else:
        coders, packed = [], b""
    return {
        "archive_id": archive, "place": place, "packed": packed, "packed_crc": zlib.crc32(packed), "crc": crc if plain else None, "unpack_size": len(whole),
        "coders": [{"method": m, "properties": p, "size": s} for m, p, s in coders], "members": members, "pack_sizes": sizes,
    }


def prepare(rows: DataFrame, methods: Methods = DEFAULT, password: str | None = None, solid: bool = False) -> DataFrame:
    """Prepared blocks (PREPARED) of rows: archive_id, place, name, data (null: no stream), and
    optionally ctime_ticks, atime_ticks, mtime_ticks, windows_attributes, is_directory. Not solid: a block for each row. Solid:
    a block for each (archive_id, block), with a column `block`, its rows by place. A solid block whose
    only coder is LZMA2 with a `chunk` is encoded run by run, and comes in parts (PARTS)."""
    check_methods(methods)
    if solid and len(methods) == 1 and methods[0][0] == "LZMA2" and methods[0][1].chunk and "LZMA2" not in codecs.ENCODERS:
        return _prepare_runs(rows, methods[0][1])
    shipping.ship(rows.sparkSession)
    schema = to_arrow_schema(PREPARED)
    if solid:

        def group(table: pa.Table) -> pa.Table:
            found = sorted(table.to_pylist(), key=lambda r: r["place"])
            return pa.Table.from_pylist([_prepare(found[0]["archive_id"], found[0]["place"], found, methods, password)], schema)

        return rows.groupBy("archive_id", "block").applyInArrow(group, PREPARED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_prepare(r["archive_id"], r["place"], [r], methods, password)], schema)

    return rows.mapInArrow(run, PREPARED)


def _prepare_runs(rows: DataFrame, options: codecs.Options) -> DataFrame:
    """Solid blocks as `_prepare` makes them, but a task encodes a run, not a block: members are cut
    where a run ends, by their offsets in the block."""
    shipping.ship(rows.sparkSession)
    key = ["archive_id", "block"]
    folder = F.coalesce(F.col("is_directory"), F.lit(False)) if "is_directory" in rows.columns else F.lit(False)
    stream = F.col("data").isNotNull() & ~folder
    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")
    made = {"has_stream": stream, "is_directory": folder, "size": size, "crc": F.when(stream, F.crc32("data"))}
    given = {f.name: made.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType) for f in MEMBER}
    rows = rows.select(*key, "place", F.when(stream, F.col("data")).alias("data"), F.when(stream, size).otherwise(0).cast("long").alias("n"), F.struct(*[c.alias(k) for k, c in given.items()]).alias("member"))
    own = Window.partitionBy(*key)
    before = own.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    facts = rows.groupBy(*key).agg(F.sum("n").alias("unpack_size"), F.min("place").alias("first"), F.count("data").alias("streams"), F.max(F.when(F.col("data").isNotNull(), F.col("member.crc"))).alias("only"))
    dictionary = F.greatest(F.lit(4096), F.least(F.lit(options.dictionary_for(None)), F.greatest(F.lit(4096), F.col("unpack_size")))).cast("long")
    facts = facts.withColumn("dictionary", dictionary).withColumn("step", F.greatest(F.lit(options.chunk), F.col("dictionary")).cast("long"))
    rows = rows.join(facts, key)
    run = lambda at: F.floor(at / F.col("step")).cast("long")
    # what has no byte goes with the next byte, at the end of the block with the last
    begin = run(F.greatest(F.lit(0), F.least("at", F.col("unpack_size") - 1)))
    rows = rows.withColumn("part", F.explode(F.sequence(begin, F.when(F.col("n") > 0, run(F.col("at") + F.col("n") - 1)).otherwise(begin))))
    low = F.greatest("at", F.col("part") * F.col("step"))
    high = F.least(F.col("at") + F.col("n"), (F.col("part") + 1) * F.col("step"))
    piece = F.when(F.col("n") > 0, F.substring(F.col("data"), (low - F.col("at") + 1).cast("int"), (high - low).cast("int")))
    pieces = rows.select(*key, "part", "place", "at", "n", piece.alias("data"), F.when(F.col("part") == begin, F.col("member")).alias("member"), "unpack_size", "first", "streams", "only", "dictionary", "step")
    schema = to_arrow_schema(PARTS)

    def encode(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: (r["at"], r["n"], r["place"]))
        f = found[0]
        plain = b"".join([r["data"] for r in found if r["data"]])
        last = (f["part"] + 1) * f["step"] >= f["unpack_size"]
        packed = (codecs.lzma2_run(plain, options, f["dictionary"]) if plain else b"") + (b"\0" if last and f["streams"] else b"")
        coders = [{"method": "LZMA2", "properties": bytes([codecs.lzma2_property(f["dictionary"])]), "size": f["unpack_size"]}] if f["streams"] else []
        return pa.Table.from_pylist([{
            "archive_id": f["archive_id"], "place": f["first"], "packed": packed, "packed_crc": zlib.crc32(packed), "crc": f["only"] if f["streams"] == 1 else None, "unpack_size": f["unpack_size"],
            "coders": coders, "members": [r["member"] for r in found if r["member"] is not None], "pack_sizes": None, "part": f["part"],
        }], schema)

    return pieces.groupBy(*key, "part").applyInArrow(encode, PARTS)


def assemble(prepared: DataFrame, password: str | None = None, compress_header: bool = True, encrypt_header: bool = True) -> DataFrame:
    """Writes an archive for each archive_id (its path); gives archive_id, n_bytes, n_entries,
    n_blocks. Blocks of an archive come to one task by place, and stream through it."""
    shipping.ship(prepared.sparkSession)
    schema = pa.schema([("archive_id", pa.string()), ("n_bytes", pa.int64()), ("n_entries", pa.int64()), ("n_blocks", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Archive | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if current is None or current.path != row["archive_id"]:
                    if current is not None:
                        yield pa.RecordBatch.from_pylist([current.finish(password if encrypt_header else None, compress_header)], schema)
                    current = _Archive(row["archive_id"])
                current.append(row)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.finish(password if encrypt_header else None, compress_header)], schema)

    order = ["place", "part"] if "part" in prepared.columns else ["place"]
    rows = prepared.repartition(F.col("archive_id")).sortWithinPartitions("archive_id", *order)
    return rows.mapInArrow(run, "archive_id string, n_bytes long, n_entries long, n_blocks long")


class _Archive:
    """An archive as it grows; a failure leaves its parts for the next attempt to replace."""

    def __init__(self, path: str):
        self.path, self.packed, self.sizes, self.crcs = path, 0, [], []
        self.folders: list[dict] = []
        self.subs: list[list] = []
        self.files: list[dict] = []
        self.store, self.name = storage.resolve(path)
        self.body = f"{self.name}.body"
        if "/" in self.name:
            self.store.create_dir(self.name.rsplit("/", 1)[0], recursive=True)
        self.out = self.store.open_output_stream(self.body)

    def append(self, row: dict) -> None:
        members = row["members"]
        if row["coders"] and row.get("part"):
            self.subs[-1] += [(m["size"], m["crc"]) for m in members if m["has_stream"]]
            self.sizes[-1] += len(row["packed"])
            self.crcs[-1] = combine(self.crcs[-1], row["packed_crc"], len(row["packed"]))
            self.out.write(row["packed"])
            self.packed += len(row["packed"])
        elif row["coders"]:
            found = [(c["method"], c["properties"], c["size"]) for c in row["coders"]]
            folder = header.bcj2_folder(found) if row.get("pack_sizes") else header.chain_folder(found)
            streams = [m for m in members if m["has_stream"]]
            # of a block in parts the first doesn't hold all members, but its checksum is null unless there is one
            folder["crc"] = row["crc"] if len(streams) == 1 or "part" in row else None
            self.folders.append(folder)
            self.subs.append([(m["size"], m["crc"]) for m in streams])
            at = 0
            for size in row.get("pack_sizes") or [len(row["packed"])]:
                self.sizes.append(size)
                self.crcs.append(zlib.crc32(row["packed"][at : at + size]) if row.get("pack_sizes") else row["packed_crc"])
                at += size
            self.out.write(row["packed"])
            self.packed += len(row["packed"])
        self.files += members

    def finish(self, password: str | None, compress: bool) -> dict:
        self.out.close()
        head = header.write_header(0, self.sizes, self.crcs, self.folders, self.subs, self.files) if self.files else b""
        start, tail = header.close(head, self.packed, compress, password) if head else (header.SIGNATURE + b"\0\4" + _empty(), b"")

        def parts() -> Iterator[bytes]:
            yield start
            with self.store.open_input_stream(self.body) as f:
                while part := f.read(1 << 22):
                    yield part
            yield tail

        storage.write_whole(self.path, parts())
        self.store.delete_file(self.body)
        return {"archive_id": self.path, "n_bytes": len(start) + self.packed + len(tail), "n_entries": len(self.files), "n_blocks": len(self.folders)}


def _empty() -> bytes:
    import struct

    fields = bytes(20)
    return struct.pack("<I", zlib.crc32(fields)) + fields


def copy_blocks(cat, rename: Column) -> DataFrame:
    """Prepared blocks out of archives as they are: packed bytes, coders and CRCs, names by `rename`,
    without decoding. Only blocks whose members all have a CRC and whose coders form a chain."""
    from foldlake.operators import catalog as derive
    from foldlake.sources.archives import block_plan

    spark = cat.parsed.sparkSession
    mapped = derive.file_blocks(cat.entries, cat.blocks)
    good = derive.raw_copy(cat.blocks, mapped, cat.sub_streams, rename).groupBy("archive_id", "block_index").agg(
        F.sort_array(F.collect_list(F.struct("position", "name", "size", "crc", "ctime_ticks", "atime_ticks", "mtime_ticks", "windows_attributes"))).alias("renamed")
    )
    plan = block_plan(cat).where(F.size("packed_streams") == 1).join(good, ["archive_id", "block_index"])
    plan = plan.repartition(F.xxhash64("archive_id", "block_index"))
    schema = to_arrow_schema(PREPARED)
    shipping.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with storage.opened(row["archive_id"]) as (read, _):
                    p = row["packs"][0]
                    packed = read(header.HEADER_SIZE + row["pack_pos"] + p["offset"], p["size"])
                members = [{**{k: m[k] for k in ("name", "size", "crc", "ctime_ticks", "atime_ticks", "mtime_ticks", "windows_attributes")}, "has_stream": True, "is_directory": False} for m in row["renamed"]]
                coders = [{"method": c["method"], "properties": c["properties"], "size": s} for c, s in zip(row["coders"], row["unpack_sizes"], strict=True)]
                yield pa.RecordBatch.from_pylist([{
                    "archive_id": row["archive_id"], "place": row["block_index"], "packed": packed, "packed_crc": zlib.crc32(packed),
                    "crc": row["block_crc"] if row["block_crc"] is not None else members[0]["crc"] if len(members) == 1 else None,
                    "unpack_size": row["unpack_size"], "coders": coders, "members": members, "pack_sizes": None,
                }], schema)

    return plan.mapInArrow(run, PREPARED)
