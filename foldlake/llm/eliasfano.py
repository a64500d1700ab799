"""Token files: ids of many documents in one array, document boundaries in Elias-Fano code.

A file holds, after a header of 96 bytes, the low bits of the n + 1 boundaries, their high bits in
unary, sampled places of ones for select, the doc_ids in the same code, and the ids in little-endian
words of 2 or 4 bytes. A boundary takes about 2 + log2(ids / documents) bits. `TokenFile` gives the
ids of document i from two selects, without a table of offsets.

`write` encodes each document where it is read, then deals the ids out by ranges of doc_id (bounds
from a bounded sample, as a sort has them), sorts and writes files of at most about `file_ids` ids
and `FILE_DOCS` documents straight to the shared folder, under a name of the task attempt; only a
manifest row that Spark commits makes a file part of the set, so a lost or repeated attempt leaves at
most an unused file. `read` reads the files back, each document by two selects.

Defined results: a null or empty text has the end id alone; of equal doc_ids the order is by a hash
of the text, and each row stays; rows with a null doc_id come first; doc_ids of other types than
integers stand in the file as an Arrow stream; an empty table writes no file and gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from . import common, tokens

END_ID = 2
MAGIC = b"FLTK\x01\0\0\0"
#: A sampled place for so many ones of the high bits.
SAMPLE = 256
FILE_IDS = 16 << 20
FILE_DOCS = 1 << 20
#: Values that are put in code at once (a multiple of 8).
BLOCK = 1 << 13
#: Rows for each partition that the bounds of the ranges are taken from.
SAMPLED = 60
#: Documents of a file that are read back at once.
DOCS_OUT = 1 << 15


class EliasFano:
    """A sequence of integers that never falls, from 0 to `universe`."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width = n, width
        self.low, self.high = low, high
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = np.asarray(values, np.uint64), len(values)
        width = max(0, (universe // n).bit_length() - 1) if n else 0
        low, places = bytearray(), np.arange(width, dtype=np.uint64)
        for i in range(0, n if width else 0, BLOCK):
            bits = (values[i : i + BLOCK, None] >> places) & np.uint64(1)
            low += np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, width, bytes(low), np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        at = i * self.width
        part = int.from_bytes(self.low[at >> 3 : (at + self.width + 7) >> 3], "little")
        return (part >> (at & 7)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """The i-th value: the place of the i-th one, from the sample before it on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        while left:
            at += 1
            byte = self.high[at >> 3] >> (at & 7)
            if (ones := byte.bit_count()) < left:
                left -= ones
                at |= 7
            else:
                while True:
                    left -= byte & 1
                    if not left:
                        break
                    byte >>= 1
                    at += 1
        return ((at - i) << self.width) | self._low(i)

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.width
        if self.width and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width]
            out += bits.reshape(self.n, self.width) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        samples = self.samples.tobytes()
        return struct.pack("<QIIII", self.n, self.width, len(self.low), len(self.high), len(samples)) + self.low + self.high + samples

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, width, *sizes = struct.unpack_from("<QIIII", data, at)
        at += 24
        parts = []
        for size in sizes:
            parts.append(bytes(data[at : at + size]))
            at += size
        return cls(n, width, *parts), at


_HEAD = struct.Struct("<8sIIQQQqQQQ24x")


def _named(doc_ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", doc_ids.type)])) as out:
        out.write_batch(pa.record_batch([doc_ids], ["doc_id"]))
    return sink.getvalue().to_pybytes()


def pack_file(doc_ids: pa.Array, lengths: np.ndarray, ids: bytes, id_size: int) -> bytes:
    """A token file. doc_ids ascend, nulls first."""
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths)]), len(ids) // id_size).to_bytes()
    nulls, least, coded = doc_ids.null_count, 0, pa.types.is_integer(doc_ids.type)
    if coded:
        known = doc_ids.slice(nulls).cast(pa.int64()).to_numpy()
        least = int(known[0]) if len(known) else 0
        # in 64 bits without a sign, the difference of any two is right
        names = EliasFano.encode(known.view(np.uint64) - np.uint64(least & (1 << 64) - 1), int(known[-1]) - least if len(known) else 0).to_bytes()
    else:
        names = _named(doc_ids)
    head = _HEAD.pack(MAGIC, id_size, int(coded), len(doc_ids), len(ids) // id_size, nulls, least, len(bounds), len(names), zlib.crc32(ids))
    return head + bounds + names + ids


class TokenFile:
    def __init__(self, data: bytes):
        magic, self.id_size, coded, self.n_docs, self.n_ids, self.nulls, self.least, bounds, names, self.crc = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size + bounds
        self.bounds, _ = EliasFano.from_bytes(data, _HEAD.size)
        self.names = EliasFano.from_bytes(data, at)[0] if coded else pa.ipc.open_stream(data[at : at + names]).read_all().column(0).to_pylist()
        self.ids = np.frombuffer(data, "<u2" if self.id_size == 2 else "<u4", self.n_ids, at + names)
        if zlib.crc32(self.ids.tobytes()) != self.crc:
            raise ValueError("the ids of a token file are damaged")

    def doc_ids(self) -> list:
        if isinstance(self.names, list):
            return self.names
        return [None] * self.nulls + [x + self.least for x in self.names.values().tolist()]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """Keys (known, doc_id, tie) between ranges that hold about as many rows each."""
    share = min(1.0, SAMPLED * parts / max(1, rows.count()))
    keys = sorted((r.doc_id is not None, r.doc_id, r.tie) for r in rows.select("doc_id", "tie").sample(share, 1).collect())
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def write(docs: DataFrame, spec: str, end_id: int = END_ID, file_ids: int = FILE_IDS, folder: str | None = None) -> DataFrame:
    """Writes the token files; gives their manifest: path, part, seq, n_docs, n_ids, n_bytes."""
    spark = docs.sparkSession
    common.ship(spark)
    folder = folder or common.scratch(spark, "tokens")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    parts = common.shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast((spec, _bounds(rows, parts)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bounds = tokens.encoder(shared.value[0]), shared.value[1]
        size = own.kind.itemsize
        for batch in common.slices(batches, "text", tokens.ROWS, tokens.CHARS):
            ids, stops = own.encode(batch.column("text"), end_id)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(stops * size), pa.py_buffer(ids.tobytes())])
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), strict=True)
            part = [bisect_right(bounds, (d is not None, d, t)) for d, t in keys]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(part, pa.int32()), data.cast(pa.binary())], ["doc_id", "tie", "part", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, task = tokens.encoder(shared.value[0]).kind.itemsize, TaskContext.get()
        held: list[pa.RecordBatch] = []
        part, seq, room, space = -1, 0, file_ids, FILE_DOCS

        def flush() -> pa.RecordBatch:
            names = pa.concat_arrays([b.column("doc_id") for b in held])
            lengths = np.concatenate([pc.binary_length(b.column("ids")).to_numpy() for b in held]).astype(np.int64) // size
            data = pack_file(names, lengths, b"".join(x.as_buffer() for b in held for x in b.column("ids")), size)
            path = f"{folder}/tokens-{part:06d}-{seq:05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.fltk"
            place, at = common.filesystem(path)
            place.create_dir(os.path.dirname(at), recursive=True)
            with place.open_output_stream(at) as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"path": path, "part": part, "seq": seq, "n_docs": len(names), "n_ids": int(lengths.sum()), "n_bytes": len(data)}], schema)

        for batch in batches:
            of = batch.column("part").to_numpy()
            sizes = pc.binary_length(batch.column("ids")).to_numpy().astype(np.int64) // size
            at = 0
            while at < len(batch):
                if of[at] != part:
                    if held:
                        yield flush()
                    held, part, seq, room, space = [], int(of[at]), 0, file_ids, FILE_DOCS
                stop = int(np.searchsorted(of, part, "right"))
                fit = int(np.searchsorted(np.cumsum(sizes[at:stop]), room, "right"))
                n = min(max(fit, not held), space, stop - at)
                if n:
                    held.append(batch.slice(at, n))
                    room, space, at = room - int(sizes[at : at + n].sum()), space - n, at + n
                if held and at < stop:
                    yield flush()
                    held, seq, room, space = [], seq + 1, file_ids, FILE_DOCS
        if held:
            yield flush()

    encoded = rows.mapInArrow(encode, f"doc_id {kind}, tie long, part int, ids binary")
    ordered = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie").select("part", "doc_id", "ids")
    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
    return common.written(ordered.mapInArrow(store, "path string, part int, seq int, n_docs long, n_ids long, n_bytes long"), "manifest")


def read(manifest: DataFrame, doc_id: str = "bigint") -> DataFrame:
    """From the files: doc_id (of the type that is given), start (ids of all documents before it),
    n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    common.ship(spark)
    # one row for each file
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    files = files.repartition(common.shuffle_partitions(spark))
    kind = to_arrow_type(_parse_datatype_string(doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place, at = common.filesystem(row["path"])
                with place.open_input_stream(at) as f:
                    file = TokenFile(f.readall())
                names = file.doc_ids()
                for first in range(0, file.n_docs, DOCS_OUT):
                    stops = [file.bounds.select(i) for i in range(first, min(first + DOCS_OUT, file.n_docs) + 1)]
                    words = memoryview(file.ids[stops[0] : stops[-1]].astype("<u4").tobytes())
                    crcs = [zlib.crc32(words[4 * (a - stops[0]) : 4 * (b - stops[0])]) for a, b in itertools.pairwise(stops)]
                    columns = [pa.array(names[first : first + len(crcs)], kind), pa.array([row["base"] + a for a in stops[:-1]], pa.int64()), pa.array([b - a for a, b in itertools.pairwise(stops)], pa.int64()), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, f"doc_id {doc_id}, start long, n_tokens long, ids_crc32 long")
