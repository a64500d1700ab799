"""Archives as tables: the catalog out of headers, and the bytes of members.

`catalog` parses each header once, in a task of its own, into one nested row; the tables are
projections of that. `contents` deals the blocks to tasks, decodes each along its coder graph as a stream and cuts it into
members; long members come in chunks, so neither a cell nor a task grows with a block. Errors are
values: a block that can't be decoded yields a row with its error and no data.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foldlake import schemas
from foldlake.functions import codecs, streams
from foldlake.functions.errors import ArchiveError
from foldlake.operators import catalog as derive
from foldlake.operators.limits import ArchiveLimits
from foldlake.sources import header, shipping, storage

CHUNK = 1 << 20


def each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time: a row can hold all members of a block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """Rows by a hash of the key over a fixed number of tasks. These rows are small and their work is
    not, so partitions mustn't be put together by their bytes."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, F.xxhash64(*key))


def rows_of(path: str, parsed: header.Parsed) -> dict:
    """One nested row for an archive."""
    s = parsed.streams
    blocks = [
        {
            "block_index": b, "crc": f["crc"], "num_sub_streams": f["num_sub_streams"], "num_packed": len(f["packed_streams"]), "unpack_size": f["unpack_size"],
            "unpack_sizes": f["unpack_sizes"], "bind_pairs": f["bind_pairs"], "packed_streams": f["packed_streams"],
            "coders": [{"method_id": c["method_id"], "method": codecs.NAMES.get(c["method_id"]), "num_in": c["num_in"], "num_out": c["num_out"], "properties": c["properties"]} for c in f["coders"]],
        }
        for b, f in enumerate(s.folders)
    ]
    return {
        "archive_id": path, "length": parsed.length, "major": parsed.major, "minor": parsed.minor, "next_header_offset": parsed.next_offset,
        "next_header_size": parsed.next_size, "next_header_crc": parsed.next_crc, "pack_pos": s.pack_pos, "error": None,
        "entries": parsed.files, "blocks": blocks, "sub_streams": s.sub_streams,
        "pack_streams": [{"pack_index": i, "size": size, "crc": crc} for i, (size, crc) in enumerate(zip(s.pack_sizes, s.pack_crcs, strict=True))],
    }


def error_row(path: str, e: Exception) -> dict:
    if isinstance(e, ArchiveError):
        what = {"code": e.code, "message": e.message, "limit": e.limit, "allowed": e.allowed, "requested": e.requested}
    else:
        what = {"code": "Io", "message": str(e), "limit": None, "allowed": None, "requested": None}
    return {"archive_id": path, "error": what}


def _decimals(row: dict) -> dict:
    from decimal import Decimal

    for f in row.get("entries") or []:
        for k in ("ctime_ticks", "atime_ticks", "mtime_ticks"):
            f[k] = None if f[k] is None else Decimal(f[k])
    return row


def parse_one(path: str, limits: ArchiveLimits, password: str | None, volumes: list[str] | None = None) -> dict:
    try:
        with storage.opened(volumes or path) as (read, length):
            return _decimals(rows_of(path, header.parse(read, length, limits, password)))
    except (ArchiveError, OSError) as e:
        return error_row(path, e)


@dataclasses.dataclass
class Catalog:
    """The tables of a set of archives. parsed has a row for each, with its error if it has one; it is
    kept until close()."""

    parsed: DataFrame

    def close(self) -> None:
        self.parsed.unpersist()

    def __enter__(self) -> Catalog:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _table(self, name: str) -> DataFrame:
        rows = self.parsed.where("error is null")
        return rows.select("archive_id", F.explode(name).alias("x")).select("archive_id", "x.*")

    @property
    def archives(self) -> DataFrame:
        return self.parsed.where("error is null").select(*[f.name for f in schemas.ARCHIVES])

    @property
    def errors(self) -> DataFrame:
        return self.parsed.where("error is not null").select("archive_id", "error.*")

    @property
    def entries(self) -> DataFrame:
        cols = [f.name for f in schemas.ENTRIES]
        return self._table("entries").select(*cols)

    @property
    def blocks(self) -> DataFrame:
        return self._table("blocks")

    @property
    def pack_streams(self) -> DataFrame:
        return self._table("pack_streams")

    @property
    def sub_streams(self) -> DataFrame:
        return self._table("sub_streams")

    @property
    def coders(self) -> DataFrame:
        rows = self.blocks.select("archive_id", "block_index", F.posexplode("coders").alias("coder_index", "c"))
        return rows.select("archive_id", "block_index", F.col("coder_index").cast("long").alias("coder_index"), "c.method_id", "c.method", "c.num_in", "c.num_out", "c.properties")

    def mapped(self) -> DataFrame:
        """entries with their block, position and packed size."""
        mapped = derive.file_blocks(self.entries, self.blocks)
        ranges = derive.pack_ranges(self.pack_streams)
        return derive.compressed_sizes(mapped, derive.block_pack_ranges(self.blocks, ranges))


def catalog(spark: SparkSession, paths: str | list[str], limits: ArchiveLimits = ArchiveLimits(), password: str | None = None, volumes: dict[str, list[str]] | None = None) -> Catalog:  # noqa: B008
    """paths: archives, or folders that hold them. volumes: for an archive in parts, these in order."""
    shipping.ship(spark)
    found = sorted(volumes) if volumes else storage.listed([paths] if isinstance(paths, str) else paths)
    names = spark.createDataFrame([(p,) for p in found], "path string").repartition(max(1, min(len(found), spark.sparkContext.defaultParallelism * 4)))
    schema = to_arrow_schema(schemas.PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_pylist([parse_one(path, limits, password, (volumes or {}).get(path))], schema)

    return Catalog(names.mapInArrow(run, schemas.PARSED).persist())


def block_plan(cat: Catalog) -> DataFrame:
    """One row for each block: where its packed streams are, its graph, and its members in order."""
    ranges = derive.pack_ranges(cat.pack_streams)
    packs = derive.block_pack_ranges(cat.blocks, ranges).groupBy("archive_id", "block_index").agg(F.sort_array(F.collect_list(F.struct("pack_index", "offset", "size"))).alias("packs"))
    members = derive.file_blocks(cat.entries, cat.blocks).where("has_stream").groupBy("archive_id", "block_index")
    members = members.agg(F.sort_array(F.collect_list(F.struct("position", "file_index", "name", "size", "crc"))).alias("members"))
    key = ["archive_id", "block_index"]
    blocks = cat.blocks.select(*key, F.col("crc").alias("block_crc"), "unpack_size", "unpack_sizes", "coders", "bind_pairs", "packed_streams")
    return blocks.join(packs, key, "left").join(members, key).join(cat.archives.select("archive_id", "pack_pos"), "archive_id")


def _packed(read: storage.Read, at: int, size: int) -> Iterator[bytes]:
    while size > 0:
        part = read(at, min(size, streams.STEP))
        if not part:
            raise ArchiveError("Corrupted", "packed bytes are cut short")
        yield part
        at, size = at + len(part), size - len(part)


def block_bytes(row: dict, read: storage.Read, password: str | None) -> Iterator[bytes]:
    """A planned block's bytes in pieces. A chain of coders is a chain of streams; a graph with
    several inputs is decoded whole."""
    coders, start = row["coders"], header.HEADER_SIZE + row["pack_pos"]
    packs = [(start + p["offset"], p["size"]) for p in row["packs"] or []]
    root = header.validate_graph(row)
    if len(packs) != 1 or any(c["num_in"] != 1 for c in coders):
        inputs = [b"".join(_packed(read, at, size)) for at, size in packs]
        yield header.decode_folder(row, inputs, password)
        return
    source, chain = {p["in_index"]: p["out_index"] for p in row["bind_pairs"]}, [root]
    while chain[-1] in source:
        chain.append(source[chain[-1]])
    parts = _packed(read, *packs[0])
    for k in reversed(chain):
        parts = streams.decoded(codecs.NAMES.get(bytes(coders[k]["method_id"])), bytes(coders[k]["properties"]), parts, row["unpack_sizes"][k], password)
    yield from parts


def decode_block(row: dict, read: storage.Read, password: str | None, verify: bool, chunk: int) -> Iterator[dict]:
    """Rows of `contents` of one planned block. An error of the block comes as a row of its own,
    behind what could be decoded before it."""
    base = {"archive_id": row["archive_id"], "block_index": row["block_index"], "file_index": None, "name": None, "offset": None, "data": None, "crc32": None, "error": None}
    aes = any(c["method"] == "AES256_SHA256" for c in row["coders"])
    whole = 0
    try:
        source = streams.Source(block_bytes(row, read, password))
        for m in row["members"]:
            crc = at = 0
            while True:
                data = source.read(min(chunk, m["size"] - at))
                if not data and at < m["size"]:
                    raise ArchiveError("Corrupted", "the block ends before its members")
                crc, whole = zlib.crc32(data, crc), zlib.crc32(data, whole)
                last = at + len(data) == m["size"]
                bad = last and verify and m["crc"] is not None and crc != m["crc"]
                error = ("Password" if aes else "ChecksumMismatch") + ": the member's checksum" if bad else None
                yield {**base, "file_index": m["file_index"], "name": m["name"], "offset": at, "data": data, "crc32": crc, "error": error}
                at += len(data)
                if last:
                    break
        while part := source.read(streams.STEP):
            whole = zlib.crc32(part, whole)
        if verify and row["block_crc"] is not None and whole != row["block_crc"]:
            raise ArchiveError("ChecksumMismatch", "the block's checksum")
    except ArchiveError as e:
        code = "Password" if aes and e.code in ("Corrupted", "ChecksumMismatch") else e.code
        yield {**base, "error": f"{code}: {e.message}"}


def contents(cat: Catalog, password: str | None = None, verify: bool = True, chunk: int = CHUNK, volumes: dict[str, list[str]] | None = None, only: DataFrame | None = None) -> DataFrame:
    """The bytes of all members with a stream: `schemas.CONTENTS`, in no order. crc32 is that of the
    member up to the end of the chunk; error tells a mismatch beside a member's last chunk, or stands
    alone for a block. only: the blocks to decode (archive_id, block_index)."""
    spark = cat.parsed.sparkSession
    plan = block_plan(cat)
    if only is not None:
        plan = plan.join(only.select("archive_id", "block_index"), ["archive_id", "block_index"], "left_semi")
    # by a hash of the block, so that the blocks of one large archive spread over all tasks
    plan = dealt(plan, "archive_id", "block_index")
    schema = to_arrow_schema(schemas.CONTENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each(batch):
                out: list[dict] = []
                held = 0
                with storage.opened((volumes or {}).get(row["archive_id"]) or row["archive_id"]) as (read, _):
                    for r in decode_block(row, read, password, verify, chunk):
                        out.append(r)
                        held += len(r["data"] or b"")
                        if held >= 8 * chunk or len(out) >= 10_000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return plan.mapInArrow(run, schemas.CONTENTS)


def read_file(cat: Catalog, name: str, password: str | None = None) -> DataFrame:
    """archive_id, offset, data of the members of that name: of equal names the last one."""
    last = derive.last_by_name(cat.entries.where(F.col("name") == name), "archive_id", "name")
    wanted = derive.file_blocks(cat.entries, cat.blocks).join(last.select("archive_id", "file_index"), ["archive_id", "file_index"], "left_semi")
    rows = contents(cat, password, only=wanted.where("block_index is not null"))
    return rows.join(last.select("archive_id", "file_index"), ["archive_id", "file_index"], "left_semi").select("archive_id", "offset", "data", "error")


def integrity(cat: Catalog, password: str | None = None) -> DataFrame:
    """archive_id, file_index, expected, actual of members whose stored and computed CRCs differ."""
    from foldlake.operators.integrity import verify

    chunks = contents(cat, password, verify=False).where("error is null")
    actual = chunks.groupBy("archive_id", "file_index").agg(F.max_by("crc32", "offset").alias("crc"))
    return verify(cat.entries.where("has_stream").select("archive_id", "file_index", "crc"), actual, "archive_id", "file_index")
