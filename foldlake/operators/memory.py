"""What decoding takes: coders, blocks, archives, and the windows that could be lent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from foldlake.functions import sizes


def block_memory(coders: DataFrame) -> DataFrame:
    """archive_id, block_index, bytes: the sum over a block's coders and its input buffer; null if a
    coder has no model. coders: archive_id, block_index, method, properties, or memory if known."""
    rows = coders if "memory" in coders.columns else coders.withColumn("memory", sizes.coder_memory(F.col("method"), F.col("properties")))
    unsized = F.count("*") != F.count("memory")
    return rows.groupBy("archive_id", "block_index").agg(F.when(unsized, None).otherwise(F.sum("memory") + sizes.BLOCK_INPUT).alias("bytes"))


def decoder_memory(coders: DataFrame) -> DataFrame:
    """archive_id, resident_bytes: the most that one block takes; null if one can't be sized."""
    rows = block_memory(coders)
    return rows.groupBy("archive_id").agg(F.when(F.count("*") != F.count("bytes"), None).otherwise(F.max("bytes")).alias("resident_bytes"))


def lent(blocks: DataFrame, threads: int) -> DataFrame:
    """archive_id, lent_windows, lent_bytes: over as many blocks as threads, the most windows and,
    apart from these, the most bytes. blocks: archive_id, block_index, windows, bytes."""
    own = Window.partitionBy("archive_id")
    rows = blocks.select(
        "archive_id", "windows", "bytes",
        F.row_number().over(own.orderBy(F.col("windows").desc(), "block_index")).alias("by_windows"),
        F.row_number().over(own.orderBy(F.col("bytes").desc(), "block_index")).alias("by_bytes"),
    )
    return rows.groupBy("archive_id").agg(
        F.sum(F.when(F.col("by_windows") <= threads, F.col("windows"))).alias("lent_windows"),
        F.sum(F.when(F.col("by_bytes") <= threads, F.col("bytes"))).alias("lent_bytes"),
    )
