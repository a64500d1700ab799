"""Large LZMA2 blocks by their runs: a task decodes a run, not a block.

A block of one LZMA2 coder can be cut where a chunk resets the dictionary. One pass reads the chunk
headers alone and skips the payloads; each run is then decoded on its own, its output cut at the
members' bounds. The block's checksum follows from those of the pieces by folding, so no task sees
the whole block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foldlake import schemas
from foldlake.functions import lzma2
from foldlake.functions.errors import ArchiveError, corrupted
from foldlake.operators import catalog as derive
from foldlake.operators import integrity
from foldlake.sources import archives, header, shipping, storage
from foldlake.streaming.runs import advance

RUNS = "archive_id string, block_index long, run_index long, packed_at long, packed_size long, output_offset long, output_len long, error string"
#: Bytes that are read at once: the payloads between chunk headers are no longer than 64 KiB.
WINDOW = 1 << 20
HEADER_BYTES = 6
#: Bytes of a block's output in which runs and members meet.
SPAN = 1 << 20


def block_runs(read: storage.Read, start: int, size: int, unpacked: int) -> list[tuple]:
    """(run_index, packed_at, packed_size, output_offset, output_len) of a packed stream, from its
    chunk headers; all of it or an error."""
    state, out = None, []
    for chunk in _chunks(read, start, size):
        state, closed = advance(state, [{**chunk, "packed_offset": start + chunk["packed_offset"]}])
        out += [r[:5] for r in closed]
    if sum(r[4] for r in out) != unpacked:
        raise corrupted("an LZMA2 stream has not the size that is declared")
    return out


def _chunks(read: storage.Read, start: int, size: int, window: int = WINDOW) -> Iterator[dict]:
    """The chunks of a packed stream up to its end mark, from windows of its bytes."""
    at = begin = 0
    data = b""
    while True:
        if at + HEADER_BYTES > begin + len(data) and begin + len(data) < size:
            begin, data = at, read(start + at, min(window, size - at))
        head = data[at - begin : at - begin + HEADER_BYTES]
        if not head:
            raise corrupted("an LZMA2 stream has no end")
        # a header alone: the payload counts as there if it lies within the stream
        chunk = lzma2.header_at(head)
        if chunk is None or at + chunk["packed_len"] > size:
            raise corrupted("an LZMA2 chunk is cut short")
        yield {"packed_offset": at, **chunk}
        at += chunk["packed_len"]
        if chunk["control"] == lzma2.END:
            return


def is_single_run(read: storage.Read, start: int, size: int, unpacked: int, most: int = 1024) -> bool:
    """Whether a packed stream is one run, from at most `most` chunk headers; a hint for planning:
    damage, another run or too many chunks give False."""
    state, n = None, 0
    try:
        for chunk in _chunks(read, start, size, 64):
            n += 1
            if n > most:
                return False
            state, closed = advance(state, [chunk])
            if closed:
                whole = chunk["control"] == lzma2.END and chunk["packed_offset"] + 1 == size
                return whole and len(closed) == 1 and closed[0][:2] == (0, 0) and closed[0][4] == unpacked
            if not chunk["is_reset"] and chunk["packed_offset"] == 0 or state is not None and state[4] > unpacked:
                return False
    except (ArchiveError, OSError):
        return False
    return False


def single_runs(blocks: DataFrame) -> DataFrame:
    """archive_id, block_index, single of planned blocks: which a task needn't cut."""
    shipping.ship(blocks.sparkSession)
    schema = pa.schema([("archive_id", pa.string()), ("block_index", pa.int64()), ("single", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with storage.opened(row["archive_id"]) as (read, _):
                    pack = row["packs"][0]
                    single = is_single_run(read, header.HEADER_SIZE + row["pack_pos"] + pack["offset"], pack["size"], row["unpack_size"])
                out.append({"archive_id": row["archive_id"], "block_index": row["block_index"], "single": single})
            yield pa.RecordBatch.from_pylist(out, schema)

    return blocks.repartition(F.xxhash64("archive_id", "block_index")).mapInArrow(run, "archive_id string, block_index long, single boolean")


def plan(cat: archives.Catalog) -> DataFrame:
    """Blocks of one LZMA2 coder, as archives.block_plan has them."""
    return archives.block_plan(cat).where((F.size("coders") == 1) & (F.col("coders")[0]["method"] == "LZMA2"))


def runs(blocks: DataFrame) -> DataFrame:
    """RUNS of planned blocks."""
    shipping.ship(blocks.sparkSession)
    fields = [c.split() for c in RUNS.split(", ")]
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in archives.each(batch):
                key = {"archive_id": row["archive_id"], "block_index": row["block_index"]}
                try:
                    with storage.opened(row["archive_id"]) as (read, _):
                        pack = row["packs"][0]
                        found = block_runs(read, header.HEADER_SIZE + row["pack_pos"] + pack["offset"], pack["size"], row["unpack_size"])
                    out = [{**key, **dict(zip(schema.names[2:7], r, strict=True)), "error": None} for r in found]
                except ArchiveError as e:
                    out = [{**key, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(out, schema)

    rows = blocks.select("archive_id", "block_index", "pack_pos", "packs", "unpack_size")
    return archives.dealt(rows, "archive_id", "block_index").mapInArrow(run, RUNS)


def _with_members(found: DataFrame, members: DataFrame) -> DataFrame:
    """Runs with the members that lie in each, as an array. A run and a member meet in the span where
    the later one of them begins, so this is an equi-join and no run carries its whole block's
    members. An empty member lies in the run of the next byte, at the end of the block in the last."""
    keys = ["archive_id", "block_index"]
    low = F.least("at", F.col("unpack_size") - 1)
    members = members.withColumn("low", low).withColumn("high", F.when(F.col("size") > 0, F.col("at") + F.col("size")).otherwise(low + 1))
    spans = lambda first, end: F.sequence((first / SPAN).cast("long"), ((end - 1) / SPAN).cast("long"))
    mine = members.select(*keys, "low", "high", F.struct("file_index", "name", "size", "at").alias("member"), F.explode(spans(F.col("low"), F.col("high"))).alias("span"))
    first, end = F.col("output_offset"), F.col("output_offset") + F.col("output_len")
    rows = found.withColumn("span", F.explode_outer(F.when(F.col("error").isNull(), spans(first, end))))
    there = (F.col("low") < end) & (F.col("high") > first) & ((F.greatest("low", first) / SPAN).cast("long") == F.col("span"))
    member = F.when(there, F.col("member"))
    return rows.join(mine, [*keys, "span"], "left").groupBy(*found.columns).agg(F.sort_array(F.collect_list(member)).alias("members"))


def contents(cat: archives.Catalog, chunk: int = archives.CHUNK) -> DataFrame:
    """`schemas.CONTENTS` of the planned blocks, decoded run by run. crc32 is that of the piece: a
    member's checksum is folded from its pieces (see verified)."""
    blocks = plan(cat)
    keys = ["archive_id", "block_index"]
    facts = blocks.select(*keys, "unpack_size", F.col("coders")[0]["properties"].alias("properties"))
    members = derive.file_blocks(cat.entries, cat.blocks).where("has_stream and block_index is not null").select(*keys, "file_index", "name", "size")
    members = derive.member_offsets(members).withColumnRenamed("unpacked_offset", "at").join(facts.drop("properties"), keys)
    found = runs(blocks).join(facts.drop("unpack_size"), keys)
    rows = archives.dealt(_with_members(found, members.where("unpack_size > 0")), *keys, "run_index")
    # a block without a byte has no run
    none = members.where("unpack_size = 0").select(*keys, "file_index", "name", F.lit(0).cast("long").alias("offset"), F.lit(b"").alias("data"), F.lit(0).cast("long").alias("crc32"), F.lit(None).cast("string").alias("error"))
    schema = to_arrow_schema(schemas.CONTENTS)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from foldlake.functions.codecs import lzma2_dictionary

        for batch in batches:
            for row in archives.each(batch):
                base = {"archive_id": row["archive_id"], "block_index": row["block_index"], "error": row["error"]}
                if row["error"] is None:
                    try:
                        with storage.opened(row["archive_id"]) as (read, _):
                            packed = read(row["packed_at"], row["packed_size"])
                        dictionary = min(lzma2_dictionary(row["properties"][0]), max(row["output_len"], 4096))
                        plain = lzma2.decode_run(packed, row["output_len"], dictionary)
                        if len(plain) < row["output_len"]:
                            raise corrupted("a run ends too soon")
                    except ArchiveError as e:
                        base["error"] = str(e)
                if base["error"] is not None:
                    yield pa.RecordBatch.from_pylist([base], schema)
                    continue
                out, held, first = [], 0, row["output_offset"]
                for m in row["members"]:
                    at = m["at"]
                    low, high = max(at, first), min(at + m["size"], first + row["output_len"])
                    for a in range(low, high, chunk) if m["size"] else [at]:
                        data = plain[a - first : min(a + chunk, high) - first] if m["size"] else b""
                        out.append({**base, "file_index": m["file_index"], "name": m["name"], "offset": a - at, "data": data, "crc32": zlib.crc32(data)})
                        held += len(data)
                    if held >= 8 * chunk or len(out) >= 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(decode, schemas.CONTENTS).unionByName(none)


def verified(cat: archives.Catalog, pieces: DataFrame) -> DataFrame:
    """archive_id, file_index, expected, actual of members whose folded checksum differs from the
    stored one, or whose pieces leave a gap (actual null)."""
    found = pieces.where("error is null").select("archive_id", "file_index", "offset", F.octet_length("data").cast("long").alias("len"), F.col("crc32").alias("crc"))
    folded = integrity.fold(found, "archive_id", "file_index").select("archive_id", "file_index", F.col("crc").alias("actual"))
    expected = cat.entries.where("has_stream and crc is not null").select("archive_id", "file_index", F.col("crc").alias("expected"))
    return expected.join(folded, ["archive_id", "file_index"]).where(~F.col("expected").eqNullSafe(F.col("actual")))
