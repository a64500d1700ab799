"""Folders to archive members, and members to folders."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable, Iterator
from decimal import Decimal
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foldlake.functions import attributes, paths
from foldlake.sources import shipping

#: Ticks of 100 ns from 1601 to 1970.
EPOCH_TICKS = 116_444_736_000_000_000


def walk(spark: SparkSession, root: str, archive: str, keep: Callable[[Column], Column] | None = None, stat: bool = False) -> DataFrame:
    """Rows for writer.prepare out of the files below a folder: archive_id, place, name, data,
    mtime_ticks, in the order of their names; with stat, where the executors can look at the folder as
    files of their own, also ctime_ticks (of creation, if the platform tells) and
    atime_ticks (which this read may itself have moved). `keep` is a predicate on the path; a folder that it
    refuses goes with all that lies in it. Links and special files are no files to Spark; folders
    of their own aren't listed by it, and so aren't kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^file:/*", "/")
    rows = files.select(paths.archive_name(plain, F.lit(root)).alias("name"), "path", F.col("content").alias("data"), attributes.ticks(F.col("modificationTime")).cast("decimal(20,0)").alias("mtime_ticks"))
    if keep is not None:
        parts = F.split("name", "/")
        ways = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        rows = rows.where(F.forall(ways, keep))
    # a total order by name without one task: ranks within ranges of names, and the counts before them
    by_range = rows.repartitionByRange("name").sortWithinPartitions("name")
    placed = by_range.select(F.lit(archive).alias("archive_id"), F.monotonically_increasing_id().alias("place"), "name", "data", "mtime_ticks", "path")
    return _stated(placed) if stat else placed.drop("path")


def _stated(rows: DataFrame) -> DataFrame:
    shipping.ship(rows.sparkSession)

    def ticks(ns: float | None) -> Decimal | None:
        return None if ns is None else Decimal(int(ns) // 100 + EPOCH_TICKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    found.append(os.stat(unquote(urlparse(path).path) if path.startswith("file:") else path))
                except OSError:  # a file whose times can't be read has none
                    found.append(None)
            made = [ticks(getattr(s, "st_birthtime_ns", None)) if s else None for s in found]
            seen = [ticks(s.st_atime_ns) if s else None for s in found]
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "path"]
            names = [n for n in batch.schema.names if n != "path"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.decimal128(20, 0)), pa.array(seen, pa.decimal128(20, 0))], [*names, "ctime_ticks", "atime_ticks"])

    return rows.mapInArrow(run, "archive_id string, place long, name string, data binary, mtime_ticks decimal(20,0), ctime_ticks decimal(20,0), atime_ticks decimal(20,0)")


def _confined(root: str, name: str) -> str:
    """The path below root; refused if a link stands anywhere on the way."""
    from foldlake.sources.header import unsafe_reason

    if (why := unsafe_reason(name)) is not None:
        raise PermissionError(why)
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts:
        raise PermissionError("nothing remains of the name")
    at = root
    for p in parts:
        at = os.path.join(at, p)
        if os.path.islink(at):
            raise PermissionError(f"{at} is a link")
    return at


def _times(row: dict) -> tuple[int, int] | None:
    """Nanoseconds of access and change since 1970 where the entry has one of them."""
    changed, seen = row.get("mtime_ticks"), row.get("atime_ticks")
    if changed is None and seen is None:
        return None
    at = lambda ticks: (int(ticks) - EPOCH_TICKS) * 100
    return at(seen if seen is not None else changed), at(changed if changed is not None else seen)


class Target:
    """A file as it is written beside its place; a file that is there is replaced, never truncated."""

    def __init__(self, path: str):
        self.path = path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.part = f"{path}.part-{os.getpid()}"
        self.file = open(self.part, "wb")  # noqa: SIM115

    def write(self, data: bytes) -> int:
        return self.file.write(data)

    def close(self, times: tuple[int, int] | None) -> None:
        self.file.close()
        if times is not None:
            # a time that the platform can't hold is left unset
            with contextlib.suppress(OSError, OverflowError, ValueError):
                os.utime(self.part, ns=times)
        os.replace(self.part, self.path)

    def drop(self) -> None:
        self.file.close()
        os.unlink(self.part)


def extract(contents: DataFrame, root: str, entries: DataFrame | None = None) -> DataFrame:
    """Writes members below a folder that all executors share; gives archive_id, name, n_bytes,
    error. All that goes to one place is written by one task in the order of archive, entry and
    offset, so of equal names the last one stays; a file is replaced, never truncated in place, and a
    name that isn't safe or crosses a link is refused as a value. With the catalog's entries, files get
    their times, and folders and members without a stream are made too."""
    shipping.ship(contents.sparkSession)
    schema = pa.schema([("archive_id", pa.string()), ("name", pa.string()), ("n_bytes", pa.int64()), ("error", pa.string())])
    nothing = F.lit(None)
    rows = contents.select("archive_id", "file_index", "name", "offset", "data", "error", F.lit(True).alias("has_stream"), F.lit(False).alias("is_directory"), nothing.cast("decimal(20,0)").alias("atime_ticks"), nothing.cast("decimal(20,0)").alias("mtime_ticks"))
    if entries is not None:
        # before a member's bytes comes what its entry says
        rows = rows.unionByName(entries.select("archive_id", "file_index", "name", F.lit(-1).cast("long").alias("offset"), nothing.cast("binary").alias("data"), nothing.cast("string").alias("error"), "has_stream", "is_directory", "atime_ticks", "mtime_ticks"))
    parts = F.filter(F.split(F.replace("name", F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    rows = rows.withColumn("place", F.coalesce(F.array_join(parts, "/"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: dict | None = None

        def close() -> dict:
            if current["file"] is not None:
                current["file"].close(_times(current)) if current["error"] is None else current["file"].drop()
            return {k: current[k] for k in schema.names}

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if current is None or (current["archive_id"], current["file_index"]) != (r["archive_id"], r["file_index"]):
                    if current is not None:
                        done.append(close())
                    current = {**r, "n_bytes": 0, "file": None}
                    if r["error"] is None:
                        try:
                            at = _confined(root, r["name"] or "")
                            if r["is_directory"]:
                                os.makedirs(at, exist_ok=True)
                            else:
                                current["file"] = Target(at)
                        except OSError as e:
                            current["error"] = str(e)
                if r["error"] is not None:
                    current["error"] = r["error"]
                elif current["file"] is not None and r["data"] is not None:
                    current["file"].write(r["data"])
                    current["n_bytes"] += len(r["data"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([close()], schema)

    rows = rows.repartition("place").sortWithinPartitions("place", "archive_id", "file_index", "offset").drop("place")
    return rows.mapInArrow(run, "archive_id string, name string, n_bytes long, error string")
