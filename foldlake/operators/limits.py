"""Admission: what an archive may declare before anything of it is decoded. Null is unlimited."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, functions as F

from foldlake.functions import paths, sizes


@dataclasses.dataclass(frozen=True)
class ArchiveLimits:
    """Bounds with the defaults of a careful reader; None is unlimited."""

    archive_bytes: int | None = None
    max_entries: int | None = 1 << 20
    max_blocks: int | None = 1 << 20
    max_pack_streams: int | None = 1 << 20
    max_coders_per_block: int | None = 32
    max_streams_per_coder: int | None = 32
    max_total_coders: int | None = 1 << 22
    max_header_bytes: int | None = 64 << 20
    max_header_unpacked_bytes: int | None = 256 << 20
    max_header_depth: int | None = 1
    max_name_bytes: int | None = 64 << 10
    max_names_bytes: int | None = 256 << 20
    max_unpack_bytes: int | None = None
    max_unpack_ratio: int | None = None
    max_aes_cycles_power: int | None = 24
    max_kdf_rounds: int | None = None
    memory_limit_bytes: int | None = None
    reject_unsafe_names: bool = False

    @classmethod
    def unlimited(cls) -> ArchiveLimits:
        return cls(**{f.name: None for f in dataclasses.fields(cls) if f.name != "reject_unsafe_names"})


def first_violation(checks: list[tuple[str, Column, int | Column | None]]) -> Column:
    """limit, allowed and requested of the first check whose value is over its bound, in the order
    given; null if none is."""
    out: Column = F.lit(None).cast("struct<limit:string,allowed:long,requested:long>")
    for name, value, bound in reversed(checks):
        if bound is None:
            continue
        bound = bound if isinstance(bound, Column) else F.lit(bound)
        hit = F.struct(F.lit(name).alias("limit"), bound.cast("long").alias("allowed"), value.cast("long").alias("requested"))
        out = F.when(value > bound, hit).otherwise(out)
    return out


def archive_violations(archives: DataFrame, limits: ArchiveLimits) -> DataFrame:
    """archives (entries, blocks, pack_streams, coders, unpack_bytes, packed_bytes) with violation."""
    found = first_violation([
        ("Entries", F.col("entries"), limits.max_entries),
        ("Blocks", F.col("blocks"), limits.max_blocks),
        ("PackStreams", F.col("pack_streams"), limits.max_pack_streams),
        ("TotalCoders", F.col("coders"), limits.max_total_coders),
        ("UnpackBytes", F.col("unpack_bytes"), limits.max_unpack_bytes),
    ])
    if limits.max_unpack_ratio is not None:
        over = sizes.unpack_ratio_exceeds(F.col("unpack_bytes"), F.col("packed_bytes"), F.lit(limits.max_unpack_ratio))
        ratio = F.struct(F.lit("UnpackRatio").alias("limit"), F.lit(limits.max_unpack_ratio).cast("long").alias("allowed"), sizes.unpack_ratio(F.col("unpack_bytes"), F.col("packed_bytes")).alias("requested"))
        found = F.coalesce(found, F.when(over, ratio))
    return archives.withColumn("violation", found)


def packed_beyond_file(archives: DataFrame, pack_streams: DataFrame) -> DataFrame:
    """Archives whose pack streams end behind the file: archive_id, length, packed_end."""
    ends = pack_streams.groupBy("archive_id").agg(F.sum("size").alias("packed"))
    rows = archives.join(ends, "archive_id").select("archive_id", "length", (F.col("pack_pos") + F.col("packed") + 32).alias("packed_end"))
    return rows.where("packed_end > length")


def unsafe_names(entries: DataFrame) -> DataFrame:
    """For each archive with an unsafe name the first of them: archive_id, file_index, name, reason."""
    rows = entries.withColumn("reason", paths.unsafe_path_reason(F.col("name"))).where("reason is not null")
    first = F.min_by(F.struct("file_index", "name", "reason"), "file_index")
    return rows.groupBy("archive_id").agg(first.alias("x")).select("archive_id", "x.*")


def aes_power_violations(coders: DataFrame, limits: ArchiveLimits) -> DataFrame:
    """AES coders whose work factor is over the bound; 63 stands for no derivation and is exempt."""
    power = sizes.byte_at(F.col("properties"), 0).bitwiseAND(F.lit(63).cast("long"))
    bound = min(limits.max_aes_cycles_power if limits.max_aes_cycles_power is not None else 24, 24)
    return coders.where(F.col("method") == "AES256_SHA256").withColumn("power", power).where((F.col("power") != 63) & (F.col("power") > bound))


def kdf_rounds(coders: DataFrame) -> DataFrame:
    """archive_id, rounds: what the key derivations of an archive cost, each (power, salt) once."""
    keys = coders.where("method = 'AES256_SHA256'").select("archive_id", "power", "salt").distinct()
    rounds = F.when(F.col("power") == 63, 0).otherwise(F.pow(F.lit(2), F.col("power")))
    return keys.groupBy("archive_id").agg(F.sum(rounds).cast("long").alias("rounds"))
