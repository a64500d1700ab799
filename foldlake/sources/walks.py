"""Walks over archives that call a function for each member, on the executors.

A block is one task's, and its members come in order, each with a reader of its bytes: what the
function leaves unread is passed over. A walk tells what happened as rows. The function's answer goes
for the rest: in an ordered walk False ends its block, whose other members aren't given, and other
blocks still run; in an unordered one False ends the walk: no block that has not begun is given any
more once the answer is known in the shared folder. `Cancel` ends what runs from outside.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldlake.functions import streams
from foldlake.functions.errors import ArchiveError
from foldlake.sources import archives, files, shipping, storage

DONE = "archive_id string, block_index long, file_index long, name string, event string, error string"


class EntryReader:
    """The bytes of one member, at most once."""

    def __init__(self, source: streams.Source, size: int):
        self.source, self.left, self.crc = source, size, 0

    def read(self, n: int = -1) -> bytes:
        data = self.source.read(self.left if n < 0 else min(n, self.left))
        if not data and self.left and n:
            raise ArchiveError("Corrupted", "the block ends before its members")
        self.left -= len(data)
        self.crc = zlib.crc32(data, self.crc)
        return data

    def write_rest(self, out: Any) -> int:
        """Writes what is left to out; how much that was."""
        n = 0
        while self.left:
            n += len(data := self.read(min(self.left, streams.STEP)))
            out.write(data)
        return n


def _walked(row: dict, read: storage.Read, password: str | None, verify: bool, each: Callable[[dict, EntryReader], bool | None]) -> Iterator[tuple]:
    """(file_index, name, event, error): an event for each member, and one for the block."""
    aes = any(c["method"] == "AES256_SHA256" for c in row["coders"])
    member: dict = {"file_index": None, "name": None}
    try:
        source = streams.Source(archives.block_bytes(row, read, password))
        for member in row["members"]:
            reader = EntryReader(source, member["size"])
            goes_on = each({k: member[k] for k in ("file_index", "name", "size", "crc")} | {"archive_id": row["archive_id"], "block_index": row["block_index"]}, reader)
            if goes_on is False:
                yield member["file_index"], member["name"], "stopped", None
                return
            while reader.left:
                reader.read(min(reader.left, streams.STEP))
            if verify and member["crc"] is not None and reader.crc != member["crc"]:
                raise ArchiveError("ChecksumMismatch", "the member's checksum")
            yield member["file_index"], member["name"], "entry", None
        yield None, None, "block", None
    except ArchiveError as e:
        code = "Password" if aes and e.code in ("Corrupted", "ChecksumMismatch") else e.code
        yield member["file_index"], member["name"], "failed", f"{code}: {e.message}"
    except Exception as e:  # noqa: BLE001 - what the caller's function throws ends its block, as a value
        yield member["file_index"], member["name"], "failed", f"Callback: {e}"


def each(
    cat: archives.Catalog, function: Callable[[dict, EntryReader], bool | None], password: str | None = None, ordered: bool = True, verify: bool = True, setup: Callable[[], None] | None = None, only: DataFrame | None = None,
) -> DataFrame:
    """Calls function(entry, reader) for each member with a stream; gives DONE: entry (given and
    whole), stopped (the function's False), block (all of it given and whole) and failed rows.
    setup runs in each worker first, to register coders."""
    spark = cat.parsed.sparkSession
    shipping.ship(spark)
    plan = archives.block_plan(cat)
    if only is not None:
        plan = plan.join(only.select("archive_id", "block_index"), ["archive_id", "block_index"], "left_semi")
    plan = plan.repartition(F.xxhash64("archive_id", "block_index"))
    halt = None if ordered else f"{_shared(spark)}/halt-{uuid.uuid4().hex}"
    names = [c.split()[0] for c in DONE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup is not None:
            setup()
        for batch in batches:
            for row in batch.to_pylist():
                if halt is not None and storage.there(halt):
                    return
                with storage.opened(row["archive_id"]) as (read, _):
                    found = list(_walked(row, read, password, verify, function))
                if halt is not None and any(f[2] == "stopped" for f in found):
                    storage.write_whole(halt, [b""])
                columns = zip(*[(row["archive_id"], row["block_index"], *f) for f in found], strict=True)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return plan.mapInArrow(run, DONE)


def _shared(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/foldlake/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: the driver and the executors have no folder to share")
    import tempfile

    return tempfile.mkdtemp(prefix="foldlake-")


def write_entry(entry: dict, reader: EntryReader, path: str) -> bool:
    """What extract_with does with a member if nothing else is asked for."""
    out = files.Target(path)
    try:
        reader.write_rest(out)
    except BaseException:
        out.drop()
        raise
    out.close(None)
    return True


def extract_with(cat: archives.Catalog, root: str, function: Callable[[dict, EntryReader, str], bool | None] = write_entry, password: str | None = None) -> DataFrame:
    """Calls function(entry, reader, path) for each member with its place below root, which is
    confined as in files.extract; gives DONE."""

    def place(entry: dict, reader: EntryReader) -> bool | None:
        return function(entry, reader, files._confined(root, entry["name"]))

    return each(cat, place, password)


class Cancel:
    """Ends the jobs of a walk, from any thread of the driver."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.cancelled = spark, f"foldlake-{uuid.uuid4().hex}", False

    def __call__(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


@contextmanager
def cancellable(spark: SparkSession):
    """with cancellable(spark) as cancel: jobs started inside end when cancel() is called, and raise
    ArchiveError Cancelled."""
    cancel = Cancel(spark)
    spark.sparkContext.addJobTag(cancel.tag)
    try:
        yield cancel
    except Exception as e:
        if cancel.cancelled:
            raise ArchiveError("Cancelled", "the caller ended the walk") from e
        raise
    finally:
        spark.sparkContext.removeJobTag(cancel.tag)
