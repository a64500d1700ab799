"""Plans over the blocks of an archive and the runs of a stream: gaps and islands, ordered folds.

Islands are running sums of the places where one begins, inside one window that partitions by
archive or stream. The one fold whose state can't be written as a window (bins that close) goes over
the ordered rows of an archive as a stream, with a few numbers of state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values of the plans.
STAGE_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
WORKER_BYTES = (64 << 10) + 2 * STAGE_BYTES + CHUNK_BYTES
UNORDERED_WORKER_BYTES = (64 << 10) + 3 * (CHUNK_BYTES + 64)
SOLID_BYTES = 4 << 30


def _island(starts: Column, order) -> Column:
    return F.sum(starts.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))


def _workers(threads: int, memory_limit: int | None, worker: int) -> Column:
    by_memory = F.lit(threads) if memory_limit is None else F.call_function("div", F.lit(max(0, memory_limit - CHUNK_BYTES)), F.max("memory") + F.lit(worker))
    return F.least(F.lit(threads), F.count("*"), by_memory).cast("long")


def plan_folders(blocks: DataFrame, threads: int, memory_limit: int | None = None, stage: int = STAGE_BYTES, by: tuple[str, ...] = ("archive_id",)) -> DataFrame:
    """Phases in order: `by`, phase, first_block, last_block, blocks, workers, threads_each, parallel.

    A run of neighbouring blocks of at most `stage` unpacked bytes is decoded side by side if it has
    two blocks or more and there is room for two workers; every other block is a phase of its own.
    blocks: `by`, block_index, unpack_size, memory."""
    order = Window.partitionBy(*by).orderBy("block_index")
    small = F.col("unpack_size") <= stage
    starts = ~F.col("small") | ~F.coalesce(F.lag("small").over(order), F.lit(False))
    rows = blocks.withColumn("small", small).withColumn("run", _island(starts, order))
    runs = rows.groupBy(*by, "run").agg(
        F.min("block_index").alias("first_block"), F.max("block_index").alias("last_block"), F.count("*").alias("blocks"), _workers(threads, memory_limit, WORKER_BYTES).alias("workers"),
    )
    both = (F.col("blocks") >= 2) & (F.col("workers") >= 2)
    runs = runs.withColumn("parallel", both)
    alone = rows.join(runs.where(~F.col("parallel")).select(*by, "run"), [*by, "run"], "left_semi")
    alone = alone.select(*by, F.col("block_index").alias("first_block"), F.col("block_index").alias("last_block"), F.lit(1).cast("long").alias("blocks"), F.lit(1).cast("long").alias("workers"), F.lit(threads).cast("long").alias("threads_each"), F.lit(False).alias("parallel"))
    each = F.lit(1).cast("long") if memory_limit is not None else F.greatest(F.lit(1), F.floor(F.lit(threads) / F.col("workers"))).cast("long")
    together = runs.where("parallel").select(*by, "first_block", "last_block", "blocks", "workers", each.alias("threads_each"), "parallel")
    phase = F.row_number().over(Window.partitionBy(*by).orderBy("first_block")) - 1
    return alone.unionByName(together).withColumn("phase", phase)


def plan_unordered(blocks: DataFrame, threads: int, memory_limit: int | None = None, stage: int = STAGE_BYTES) -> DataFrame:
    """Phases of a walk without order: runs of neighbouring blocks of one file each side by side,
    whatever their size; all else as plan_folders. blocks: archive_id, block_index, unpack_size,
    memory, single (at most one file with bytes), one_run (one LZMA2 run)."""
    order = Window.partitionBy("archive_id").orderBy("block_index")
    change = F.col("single") != F.lag("single").over(order)
    rows = blocks.withColumn("run", _island(F.coalesce(change, F.lit(True)), order))
    runs = rows.groupBy("archive_id", "run").agg(
        F.min("block_index").alias("first_block"), F.max("block_index").alias("last_block"), F.count("*").alias("blocks"),
        F.first("single").alias("single"), F.bool_and("one_run").alias("one_run"), _workers(threads, memory_limit, UNORDERED_WORKER_BYTES).alias("workers"),
    )
    runs = runs.withColumn("free", F.col("single") & (F.col("blocks") >= 2) & (F.col("workers") >= 2))
    each = F.when(F.col("one_run"), 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(threads) / F.col("workers")))).cast("long")
    free = runs.where("free").select("archive_id", "first_block", "last_block", "blocks", "workers", each.alias("threads_each"), F.lit("unordered").alias("kind"))
    rest = rows.join(runs.where(~F.col("free")).select("archive_id", "run"), ["archive_id", "run"], "left_semi").withColumnRenamed("run", "stretch")
    planned = plan_folders(rest, threads, memory_limit, stage, ("archive_id", "stretch"))
    planned = planned.select("archive_id", "first_block", "last_block", "blocks", "workers", "threads_each", F.when(F.col("parallel"), "parallel").otherwise("alone").alias("kind"))
    phase = F.row_number().over(Window.partitionBy("archive_id").orderBy("first_block")) - 1
    return free.unionByName(planned).withColumn("phase", phase)


def solid_bins(entries: DataFrame, limit: int = SOLID_BYTES, by: str = "archive_id", order: str = "file_index") -> DataFrame:
    """by, order, bin: files in order go into one block, which is closed before its sum would reach
    the limit; a file of that size stands alone. The state is reset, so it is a fold: over the sorted
    rows of an archive, batch after batch, in time that grows with their number alone."""
    from foldlake.sources.shipping import ship

    ship(entries.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema}
    rows = entries.select(by, order, F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")).alias("size")).repartition(by).sortWithinPartitions(by, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, at = object(), 0, 0
        for batch in batches:
            bins = np.empty(len(batch), np.int64)
            for i, (own, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if own != key:
                    key, held, at = own, size, 0
                elif held + size >= limit:
                    held, at = size, at + 1
                else:
                    held += size
                bins[i] = at
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins)], [by, order, "bin"])

    return rows.mapInArrow(run, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, bin long")


def scan_runs(chunks: DataFrame, by: tuple[str, ...] = ("archive_id", "block_index"), order: str = "packed_offset") -> DataFrame:
    """Chunks with run_index: a run begins at each chunk that resets the dictionary."""
    w = Window.partitionBy(*by).orderBy(order)
    return chunks.withColumn("run_index", _island(F.col("is_reset"), w) - 1)


def run_shapes(chunks: DataFrame, by: tuple[str, ...] = ("archive_id", "block_index"), order: str = "packed_offset") -> DataFrame:
    """For each run: chunks, packed, unpacked and LZMA-coded bytes, and whether it is stored.
    chunks: `by`, `order`, is_reset, is_stored, packed_len, unpacked_len."""
    runs = scan_runs(chunks, by, order).groupBy(*by, "run_index").agg(
        F.count("*").alias("chunks"), F.sum("packed_len").alias("packed"), F.sum("unpacked_len").alias("unpacked"),
        F.sum(F.when(~F.col("is_stored"), F.col("unpacked_len")).otherwise(0)).cast("long").alias("lzma_unpacked"),
    )
    return runs.withColumn("stored", (F.col("unpacked") > 0) & (F.col("lzma_unpacked") * 64 <= F.col("unpacked")))


def run_statistics(shapes: DataFrame, by: tuple[str, ...] = ("archive_id",)) -> DataFrame:
    """For each archive: runs, largest and smallest, chunks, stored runs."""
    return shapes.groupBy(*by).agg(F.count("*").alias("runs"), F.max("unpacked").alias("largest"), F.min("unpacked").alias("smallest"), F.sum("chunks").alias("chunks"), F.count_if("stored").alias("stored_runs"))


def shape_window(shapes: DataFrame, by: tuple[str, ...], order: str = "run_index", size: int = 8) -> DataFrame:
    """The largest packed and, apart from it, the largest unpacked size of the last `size` runs."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - size, 0)
    return shapes.withColumns({"max_packed": F.max("packed").over(w), "max_unpacked": F.max("unpacked").over(w)})


def hysteresis(shapes: DataFrame, by: tuple[str, ...], order: str = "run_index", flag: str = "stored") -> DataFrame:
    """by, order, dense: a state that starts false and follows `flag` only at the second run in a row
    that disagrees with it. So it is the flag of the last two neighbours that were alike."""
    w = Window.partitionBy(*by).orderBy(order)
    alike = F.when(F.col(flag) == F.lag(flag).over(w), F.col(flag))
    rows = shapes.select(*by, order, alike.alias("dense"))
    return rows.withColumn("dense", F.coalesce(F.last("dense", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))


def coverage(runs: DataFrame, by: tuple[str, ...] = ("archive_id", "block_index")) -> DataFrame:
    """For each stream whether its completed runs tile it: indexes from 0 without a gap, output and
    packed ranges each beginning where the one before ends; and the ends that they reach.
    runs: `by`, run_index, packed_offset, packed_size, output_offset, output_len."""
    w = Window.partitionBy(*by).orderBy("output_offset", "run_index")
    out_end, in_end = F.col("output_offset") + F.col("output_len"), F.col("packed_offset") + F.col("packed_size")
    fits = (
        (F.col("run_index") == F.row_number().over(w) - 1)
        & (F.col("output_offset") == F.coalesce(F.lag(out_end).over(w), F.lit(0)))
        & (F.col("packed_offset") == F.coalesce(F.lag(in_end).over(w), F.lit(0)))
    )
    rows = runs.withColumns({"fits": fits, "out_end": out_end, "in_end": in_end})
    return rows.groupBy(*by).agg(F.bool_and("fits").alias("tiles"), F.count("*").alias("runs"), F.max("out_end").alias("output_end"), F.max("in_end").alias("packed_end"))


def waves(samples: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """Runs claimed between two waits: by, wave, runs. samples: `by`, `order`, waits, claimed."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = samples.withColumn("wave", _island(F.col("waits"), w))
    return rows.groupBy(*by, "wave").agg(F.sum("claimed").alias("runs"))
