"""`spark.read.format("7z")`, `df.write.format("7z")` and `spark.readStream.format("7z")`.

Options for reading: path; table (archives, entries, blocks, coders, pack_streams, sub_streams,
contents; entries if not given); blockIndex and names (comma-separated) to read less of the contents;
verify; chunk; splitBytes. For a stream of chunks: path; offset; maxBytes of a batch. For writing: path;
method; level; solidBytes. A password is never an option, since
options show in plans: it is read from the environment variable that the option passwordVariable
names.

Planning lists files and no more. Metadata is a partition for each archive, contents one for each
`splitBytes` of an archive, whose task reads the header and takes its share of the blocks. A path that
ends in .7z is written as one archive, whose parts the commit copies together as a stream; any other
path is a folder in which each task writes an archive of its own, so no bytes go through the driver.
`register` adds the format to a session; with filter pushdown switched on in the session, equality on block_index and
name prunes blocks as the options do.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foldlake import schemas
from foldlake.functions import codecs, lzma2
from foldlake.functions.errors import ArchiveError
from foldlake.operators.limits import ArchiveLimits
from foldlake.schemas import PREPARED
from foldlake.sources import archives, shipping, storage, writer


def _plain(options) -> dict:
    """Options by lower-case name, as Spark doesn't tell cases apart."""
    return {k.lower(): v for k, v in options.items()}


def _password(options: dict) -> str | None:
    name = options.get("passwordvariable")
    return os.environ.get(name) if name else None


#: Packed bytes that a task of contents takes about; bytes that a batch of a stream looks at.
SPLIT_BYTES = 128 << 20
BATCH_BYTES = 64 << 20


class ArchivePartition(InputPartition):
    """An archive, or of its blocks every `of`-th from `share` on."""

    def __init__(self, path: str, share: int = 0, of: int = 1):
        self.path, self.share, self.of = path, share, of


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.table = schema, options, options.get("table", "entries")
        self.blocks = {int(x) for x in options["blockindex"].split(",")} if options.get("blockindex") else None
        self.names = set(options["names"].split(",")) if options.get("names") else None

    def partitions(self) -> list[InputPartition]:
        paths = storage.listed([self.options["path"]])
        if self.table != "contents":
            return [ArchivePartition(p) for p in paths]
        split = int(self.options.get("splitbytes", SPLIT_BYTES))
        out: list[InputPartition] = []
        for p in paths:
            of = max(1, -(-storage.size(p) // split))
            out += [ArchivePartition(p, k, of) for k in range(of)]
        return out

    def _plan(self, row: dict) -> Iterator[dict]:
        """The blocks that are asked for, as archives.block_plan has them."""
        at, packs = 0, []
        for p in row["pack_streams"]:
            packs.append({"pack_index": p["pack_index"], "offset": at, "size": p["size"]})
            at += p["size"]
        first, streamed = 0, iter([e for e in row["entries"] if e["has_stream"]])
        for b in row["blocks"]:
            members = [next(streamed) for _ in range(b["num_sub_streams"])]
            own = packs[first : first + b["num_packed"]]
            first += b["num_packed"]
            wanted = self.names is None or any(m["name"] in self.names for m in members)
            if members and wanted and (self.blocks is None or b["block_index"] in self.blocks):
                kept = [{k: m[k] for k in ("file_index", "name", "size", "crc")} for m in members]
                yield {**b, "archive_id": row["archive_id"], "block_crc": b["crc"], "packs": own, "members": kept, "pack_pos": row["pack_pos"]}

    def read(self, partition: ArchivePartition) -> Iterator[tuple]:
        names = self.schema.fieldNames()
        if self.table == "contents":
            row = archives.parse_one(partition.path, ArchiveLimits(), _password(self.options))
            if e := row["error"]:
                if partition.share == 0:
                    yield tuple(partition.path if n == "archive_id" else f"{e['code']}: {e['message']}" if n == "error" else None for n in names)
                return
            with storage.opened(partition.path) as (read, _):
                for plan in itertools.islice(self._plan(row), partition.share, None, partition.of):
                    for r in archives.decode_block(plan, read, _password(self.options), self.options.get("verify", "true") == "true", int(self.options.get("chunk", archives.CHUNK))):
                        if self.names is None or r["name"] is None or r["name"] in self.names:
                            yield tuple(r[n] for n in names)
            return
        row = archives.parse_one(partition.path, ArchiveLimits(), _password(self.options))
        if row["error"]:
            raise ArchiveError(row["error"]["code"], row["error"]["message"])
        if self.table == "archives":
            found: Any = [row]
        elif self.table == "coders":
            found = [{**c, "block_index": b["block_index"], "coder_index": i} for b in row["blocks"] for i, c in enumerate(b["coders"])]
        else:
            found = row[self.table]
        for r in found:
            yield tuple(partition.path if n == "archive_id" else _value(r[n]) for n in names)


def _value(x: Any) -> Any:
    if isinstance(x, list):
        return [_value(v) for v in x]
    return tuple(_value(v) for v in x.values()) if isinstance(x, dict) else x


class PruningReader(ArchiveReader):
    """Built where the session has filter pushdown for Python sources."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("block_index",):
                self.blocks = {f.value} if self.blocks is None else self.blocks & {f.value}
            elif isinstance(f, In) and f.attribute == ("block_index",):
                self.blocks = set(f.value) if self.blocks is None else self.blocks & set(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("name",) and self.table == "contents":
                self.names = {f.value} if self.names is None else self.names & {f.value}
            yield f  # blocks hold more than what is asked for: Spark filters the rows


class PartMessage(WriterCommitMessage):
    def __init__(self, part: str | None):
        self.part = part


class ArchiveWriter(DataSourceWriter):
    """Each task encodes its rows into a file beside the place they go to. Of a folder these are whole
    archives, and commit moves them there; of a path of one archive they are parts, and commit puts
    them together in order, as a stream. abort removes them."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool = False):
        self.names, self.options, self.overwrite = schema.fieldNames(), options, overwrite
        self.single = options["path"].endswith(".7z")
        if not {"name", "data"} <= set(self.names):
            raise ArchiveError("InvalidArgument", "rows to write have a name and data")

    def _methods(self) -> writer.Methods:
        found = [(m.strip().upper(), codecs.Options(level=int(self.options.get("level", 6)))) for m in self.options.get("method", "LZMA2").split(",")]
        if _password(self.options) is not None:
            found.append(("AES256_SHA256", codecs.Options()))
        writer.check_methods(found)
        return found

    def _prepared(self, rows: Iterator) -> Iterator[dict]:
        path, methods, password = self.options["path"], self._methods(), _password(self.options)
        solid = int(self.options.get("solidbytes", 0))
        held: list[dict] = []
        size = 0
        for row in rows:
            r = dict(zip(self.names, row, strict=True))
            r["data"] = None if r["data"] is None else bytes(r["data"])
            n = len(r["data"] or b"")
            if held and (not solid or size + n >= solid):
                yield writer._prepare(path, 0, held, methods, password)
                held, size = [], 0
            held.append(r)
            size += n
        if held:
            yield writer._prepare(path, 0, held, methods, password)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        path = self.options["path"].rstrip("/")
        base = f"{path}.parts" if self.single else f"{path}/_parts"
        name = f"{base}/part-{task.partitionId():08d}-{task.taskAttemptId()}" + ("" if self.single else ".7z")
        if not self.single:
            whole = None
            for r in self._prepared(rows):
                whole = whole or writer._Archive(name)
                whole.append(r)
            if whole is not None:
                whole.finish(_password(self.options), True)
            return PartMessage(name if whole is not None else None)
        store, at = storage.resolve(name)
        store.create_dir(os.path.dirname(at), recursive=True)
        schema, count = to_arrow_schema(PREPARED), 0
        with store.open_output_stream(at) as out, pa.ipc.new_stream(out, schema) as batches:
            for r in self._prepared(rows):
                batches.write_batch(pa.RecordBatch.from_pylist([r], schema))
                count += 1
        return PartMessage(name if count else None)

    def commit(self, messages) -> None:
        parts = sorted(m.part for m in messages if m is not None and m.part)
        path = self.options["path"].rstrip("/")
        if not self.single:
            store, folder = storage.resolve(path)
            store.create_dir(folder, recursive=True)
            old = [f for f in storage.listed([path]) if "/_parts/" not in f] if self.overwrite else []
            for f in parts:
                store.move(storage.resolve(f)[1], storage.resolve(f"{path}/{f.rsplit('/', 1)[1]}")[1])
            moved = {f.rsplit("/", 1)[1] for f in parts}
            for f in old:
                if f.rsplit("/", 1)[1] not in moved:
                    store.delete_file(storage.resolve(f)[1])
            self._clear()
            return
        whole = writer._Archive(self.options["path"])
        for name in parts:
            store, at = storage.resolve(name)
            with store.open_input_stream(at) as f, pa.ipc.open_stream(f) as batches:
                for batch in batches:
                    for row in batch.to_pylist():
                        whole.append(row)
        whole.finish(_password(self.options), True)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        path = self.options["path"].rstrip("/")
        store, at = storage.resolve(f"{path}.parts" if self.single else f"{path}/_parts")
        try:
            store.delete_dir(at)
        except FileNotFoundError:
            pass


class ChunkStream(SimpleDataSourceStreamReader):
    """Chunks of an LZMA2 stream in a file that grows. The offset is the place behind the last whole
    chunk, so a batch never looks past the bytes that are there, nor at more than maxBytes of them."""

    def __init__(self, options: dict):
        self.path, self.first = options["path"], int(options.get("offset", 0))
        # a whole chunk must fit
        self.most = max(int(options.get("maxbytes", BATCH_BYTES)), 1 << 18)

    def initialOffset(self) -> dict:
        return {"at": self.first, "done": False}

    def _from(self, at: int, end: int | None) -> tuple[list[tuple], dict]:
        with storage.opened(self.path) as (read, length):
            data = read(at, min(self.most, (length if end is None else end) - at))
        rows, done, place = [], False, at
        for c in lzma2.chunks(data, at):
            place = c["packed_offset"] + c["packed_len"]
            done = c["control"] == lzma2.END
            rows.append((self.path, 0, *(c[n] for n in lzma2.CHUNKS.fieldNames()[2:])))
        return rows, {"at": place, "done": done}

    def read(self, start: dict):
        if start["done"]:
            return iter([]), start
        rows, end = self._from(start["at"], None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._from(start["at"], end["at"])[0])


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "7z"

    def schema(self) -> StructType:
        return schemas.TABLES[self.options.get("table", "entries")] if self.options.get("table") != "chunks" else lzma2.CHUNKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(schema, _plain(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(schema, _plain(self.options), overwrite)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return ChunkStream(_plain(self.options))


class PruningSource(ArchiveSource):
    def reader(self, schema: StructType) -> DataSourceReader:
        return PruningReader(schema, _plain(self.options))


def register(spark: SparkSession) -> None:
    shipping.ship(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    spark.dataSource.register(PruningSource if pushed else ArchiveSource)


