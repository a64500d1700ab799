"""What the operators share: input tables, the shared folder, and code on the workers' path."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What Arrow calls the schemes of Hadoop's file systems.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
ROOT = str(Path(__file__).resolve().parents[2])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Python workers import this package by name. Where it isn't installed (tests, a driver that
    put it on sys.path itself) they get its folder through PYTHONPATH; a cluster gets it by
    --py-files or an installed wheel."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it
    is unset and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: the driver and the executors have no folder to share")
        made = tempfile.mkdtemp(prefix="foldlake-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(made)
        found = made
    if found.startswith("file:/") and not found.startswith("file://"):
        found = f"file://{found[5:]}"
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/foldlake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read again: its lineage ends there, and an
    executor that is lost later takes nothing with it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path, and the path there."""
    scheme, colon, rest = path.partition("://")
    if not colon:
        return fs.FileSystem.from_uri(path if path.startswith("file:") else os.path.abspath(path))
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


#: Items of an array whose results are put together at once.
CHUNK = 512


def scanned(items: Column, moves: Callable[[Column], Column], gives: Callable[[Column, Column], Column], kind: str) -> Column:
    """One array (of type kind) of gives(at, x), an array, for each x of items in order, where at is the
    sum of moves(x) of the items before it. An array that grows item by item is copied each time, so
    this goes by chunks: the work is about CHUNK / 2 copied places an item, however many there are."""
    none = F.array().cast(kind)

    def one(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + moves(x)).alias("at"), F.concat(acc["out"], gives(acc["at"], x)).alias("out"))

    def chunk(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(acc["items"], k * CHUNK + 1, CHUNK), F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.struct(acc["items"].alias("items"), part["at"].alias("at"), F.concat(acc["out"], F.array(part["out"])).alias("out"))

    zero = F.struct(items.alias("items"), F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")))
    return F.flatten(F.aggregate(chunks, zero, chunk, lambda acc: acc["out"]))


def unused(columns: list[str], stem: str) -> str:
    """A prefix for columns of one's own that none of the given ones begins with."""
    while any(c.lower().startswith(stem) for c in columns):
        stem = f"_{stem}"
    return stem


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has at most `rows` rows, and `chars` bytes of the column
    `text` or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (size + n > chars or i - start >= rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(sizes) > start:
            yield batch.slice(start)


def release() -> None:
    """Gives memory that this process has freed back to the system. Workers outlive their tasks, and what
    their allocators keep counts with the executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)
