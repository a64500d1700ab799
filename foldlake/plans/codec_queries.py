"""Round trips of members through coders, and through archives, as queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldlake.functions import codecs
from foldlake.plans import adapters
from foldlake.sources import shipping

#: Chains by name; what is decoded must be what was encoded.
CHAINS: dict[str, list[tuple[str, codecs.Options]]] = {
    "copy": [("COPY", codecs.Options())],
    "lzma": [("LZMA", codecs.Options(level=1))],
    "lzma2": [("LZMA2", codecs.Options(level=1))],
    "bzip2": [("BZIP2", codecs.Options(level=1))],
    "deflate": [("DEFLATE", codecs.Options(level=1))],
    "zstd": [("ZSTD", codecs.Options(level=3))],
    "lz4": [("LZ4", codecs.Options(frame=4096))],
    "brotli": [("BROTLI", codecs.Options(level=3, frame=4096))],
    "bcj_x86": [("BCJ_X86", codecs.Options()), ("LZMA2", codecs.Options(level=1))],
    "bcj_ppc": [("BCJ_PPC", codecs.Options()), ("LZMA2", codecs.Options(level=1))],
    "bcj_ia64": [("BCJ_IA64", codecs.Options()), ("LZMA2", codecs.Options(level=1))],
    "bcj_arm": [("BCJ_ARM", codecs.Options()), ("LZMA2", codecs.Options(level=1))],
    "bcj_arm_thumb": [("BCJ_ARM_THUMB", codecs.Options()), ("LZMA2", codecs.Options(level=1))],
    "bcj_sparc": [("BCJ_SPARC", codecs.Options()), ("LZMA2", codecs.Options(level=1))],
    "bcj_arm64": [("BCJ_ARM64", codecs.Options()), ("LZMA2", codecs.Options(level=1))],
    "bcj_riscv": [("BCJ_RISCV", codecs.Options()), ("LZMA2", codecs.Options(level=1))],
    "delta": [("DELTA", codecs.Options(distance=2)), ("LZMA2", codecs.Options(level=1))],
    "aes": [("DEFLATE", codecs.Options(level=1)), ("AES256_SHA256", codecs.Options(power=6, salt=b"foldlake", iv=bytes(16)))],
}


#: Bytes of plain values that a task holds decoded at once, beside the batch they came in; one value may be longer.
SLICE = 1 << 22


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows whose column has so many bytes at most, or one row. A batch isn't
    held while the next one is read."""
    most = SLICE if most is None else most
    for batch in batches:
        first = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > first and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        rest = batch.slice(first)
        del batch
        yield rest
        del rest


def round_trip(rows: DataFrame, key: str, data: str, methods: list[tuple[str, codecs.Options]], password: str | None = None) -> DataFrame:
    """key, and data encoded and decoded again."""
    shipping.ship(rows.sparkSession)
    schema = pa.schema([(key, pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, data):
            out = []
            for plain in part.column(data).to_pylist():
                coders, packed = codecs.encode_chain(methods, plain, password)
                for method, properties, size in reversed(coders):
                    packed = codecs.decode(method, properties, packed, size, password)
                out.append(packed)
            keys = part.column(key)
            del part
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.binary())], schema=schema)

    return rows.select(key, data).mapInArrow(run, f"{key} long, decoded binary")


def _query(methods: list[tuple[str, codecs.Options]], table: str, key: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = adapters.table(spark, sf_dir, table).select(key, F.encode("text", "UTF-8").alias("data"))
        out = round_trip(rows, key, "data", methods, "password")
        return out.select(key, F.octet_length("decoded").cast("long").alias("size"), F.sha2("decoded", 256).alias("sha256"))

    return query


def bcj2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: four streams and back."""
    from foldlake.functions import bcj2

    shipping.ship(spark)
    rows = adapters.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "data"):
            out = [bcj2.decode(bcj2.encode(d), len(d)) for d in part.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    out = rows.mapInArrow(run, "doc_id long, decoded binary")
    return out.select("doc_id", F.octet_length("decoded").cast("long").alias("size"), F.sha2("decoded", 256).alias("sha256"))


def crc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRCs of the lines of a text, folded to that of the text."""
    from foldlake.operators import integrity

    texts = adapters.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / 500)).cast("int")
    pieces = texts.select("doc_id", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    part = F.substring(F.col("data"), F.col("k") * 500 + 1, F.lit(500))
    pieces = pieces.select("doc_id", (F.col("k") * 500).cast("long").alias("offset"), F.octet_length(part).cast("long").alias("len"), F.crc32(part).alias("crc"))
    folded = integrity.fold(pieces, "doc_id")
    whole = texts.select("doc_id", F.crc32("data").alias("whole"))
    return folded.join(whole, "doc_id").select("doc_id", F.col("len").alias("size"), (F.col("crc") == F.col("whole")).alias("same"))


def _folder(spark: SparkSession) -> str:
    """A new folder that executors and driver share."""
    import os
    import tempfile

    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: the driver and the executors have no folder to share")
    return f"{shared.rstrip('/')}/foldlake/{sc.applicationId}/archives-{os.urandom(6).hex()}" if shared else tempfile.mkdtemp(prefix="foldlake-")


def _written(spark: SparkSession, sf_dir: str, options: codecs.Options, per_block: int, first: str | None = None) -> list[str]:
    """Documents in solid archives, one for each source; their paths."""
    from foldlake.sources import writer

    folder = _folder(spark)
    rows = adapters.table(spark, sf_dir, "documents").select(
        F.concat(F.lit(f"{folder}/"), "source", F.lit(".7z")).alias("archive_id"), F.col("doc_id").alias("place"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.encode("text", "UTF-8").alias("data"), F.floor(F.col("doc_id") / per_block).alias("block"),
    )
    made = writer.assemble(writer.prepare(rows, [*([(first, codecs.Options())] if first else []), ("LZMA2", options)], solid=True))
    return [r.archive_id for r in made.select("archive_id").collect()]


def _digests(contents: DataFrame) -> DataFrame:
    whole = contents.groupBy("archive_id", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", F.hex("data").alias("h")))), lambda x: x["h"]), "").alias("hex"))
    data = F.unhex("hex")
    return whole.select(F.substring_index("name", ".", 1).cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("sha256"))


def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-2, W-5, W-6, W-8, S1-S18: documents into solid archives of their sources, and read from there."""
    from foldlake.sources import archives

    return _digests(archives.contents(archives.catalog(spark, _written(spark, sf_dir, codecs.Options(level=1), 2000))))


def archive_bcj2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives whose blocks are graphs of four packed streams, written and read."""
    from foldlake.sources import archives

    return _digests(archives.contents(archives.catalog(spark, _written(spark, sf_dir, codecs.Options(level=1), 2000, "BCJ2"))))


def archive_by_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of one block each, decoded run by run."""
    from foldlake.sources import archives, run_scan

    paths = _written(spark, sf_dir, codecs.Options(level=1, dictionary=1 << 16, chunk=1 << 16), 1 << 40)
    return _digests(run_scan.contents(archives.catalog(spark, paths)))


def aes_on_spark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 on Spark's own functions, with a key that is no secret."""
    from foldlake.functions import native_aes

    data, key, iv = F.encode("text", "UTF-8"), F.sha2(F.lit("a key of the tests"), 256), F.lit(bytes(range(16)))
    packed = native_aes.encrypt(data, F.unhex(key), iv)
    plain = native_aes.decrypt(packed, F.unhex(key), iv, F.octet_length(data))
    rows = adapters.table(spark, sf_dir, "documents").select("doc_id", plain.alias("d"))
    return rows.select("doc_id", F.octet_length("d").cast("long").alias("size"), F.sha2("d", 256).alias("sha256"))


def queries() -> dict:
    digest = "SELECT {key}, strlen(text) AS size, sha256(text) AS sha256 FROM {table}"
    out = {f"codec_roundtrip_{name}": (_query(chain, "documents", "doc_id"), digest.format(key="doc_id", table="documents")) for name, chain in CHAINS.items()}
    out["bcj2_roundtrip"] = bcj2_roundtrip, digest.format(key="doc_id", table="documents")
    out["archive_bcj2"] = archive_bcj2, digest.format(key="doc_id", table="documents")
    out["crc_fold"] = crc_fold, "SELECT doc_id, strlen(text) AS size, true AS same FROM documents"
    out["archive_by_runs"] = archive_by_runs, digest.format(key="doc_id", table="documents")
    out["aes_on_spark"] = aes_on_spark, digest.format(key="doc_id", table="documents")
    out["archive_roundtrip"] = archive_roundtrip, digest.format(key="doc_id", table="documents")
    return out
