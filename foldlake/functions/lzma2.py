"""LZMA2 streams: their chunks, without decoding them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from foldlake.functions.errors import corrupted
from foldlake.schemas import FLAG, INT, LONG, TEXT, table

CHUNKS = table(archive_id=TEXT, block_index=LONG, packed_offset=LONG, control=INT, header_len=INT, packed_len=LONG, unpacked_len=LONG, is_reset=FLAG, is_stored=FLAG)
END = 0


def header_at(data: bytes, at: int = 0) -> dict | None:
    """The chunk whose header is at a place: None if that isn't all there. A control of 0 ends the
    stream. packed_len holds header and payload."""
    if at >= len(data):
        return None
    control = data[at]
    if control == END:
        return {"control": 0, "header_len": 1, "packed_len": 1, "unpacked_len": 0, "is_reset": False, "is_stored": False}
    stored = control < 0x80
    if stored and control > 2:
        raise corrupted(f"LZMA2 control {control:#x}")
    header = 3 if stored else 6 if control >= 0xC0 else 5
    if at + header > len(data):
        return None
    if stored:
        unpacked = payload = int.from_bytes(data[at + 1 : at + 3], "big") + 1
    else:
        unpacked = ((control & 0x1F) << 16) + int.from_bytes(data[at + 1 : at + 3], "big") + 1
        payload = int.from_bytes(data[at + 3 : at + 5], "big") + 1
    return {"control": control, "header_len": header, "packed_len": header + payload, "unpacked_len": unpacked, "is_reset": control == 1 or control >= 0xE0, "is_stored": stored}


def chunk_at(data: bytes, at: int) -> dict | None:
    """The chunk at a place: None if its header or payload isn't all there."""
    found = header_at(data, at)
    return None if found is None or at + found["packed_len"] > len(data) else found


def chunks(data: bytes, base: int = 0) -> Iterator[dict]:
    """The whole chunks from the start of data on, up to the end mark or the last whole one."""
    at = 0
    while (c := chunk_at(data, at)) is not None:
        yield {"packed_offset": base + at, **c}
        at += c["packed_len"]
        if c["control"] == END:
            return


def scan(streams: DataFrame) -> DataFrame:
    """CHUNKS of streams (archive_id, block_index, packed BINARY); the end mark is no chunk."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from foldlake.sources.shipping import ship

    ship(streams.sparkSession)
    schema = to_arrow_schema(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [{"archive_id": row["archive_id"], "block_index": row["block_index"], **c} for c in chunks(row["packed"]) if c["control"] != END]
                yield pa.RecordBatch.from_pylist(found, schema)

    return streams.select("archive_id", "block_index", "packed").mapInArrow(run, CHUNKS)


def decode_run(packed: bytes, unpacked: int, dictionary: int = 1 << 26) -> bytes:
    """A run of chunks that begins with a reset, on its own."""
    import lzma

    from foldlake.functions.codecs import _raw

    return _raw(packed + b"\0", [{"id": lzma.FILTER_LZMA2, "dict_size": max(4096, dictionary)}], unpacked)
