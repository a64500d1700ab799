"""What a stream of completed blocks publishes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def published(completions: DataFrame) -> DataFrame:
    """For each archive: blocks checked, those published (verified), and the first that failed. Works
    on a batch as on a stream (update mode). completions: archive_id, block_index, verified."""
    return completions.groupBy("archive_id").agg(
        F.count("*").alias("checked"), F.sum(F.col("verified").cast("long")).alias("published"), F.min(F.when(~F.col("verified"), F.col("block_index"))).alias("first_failed")
    )
