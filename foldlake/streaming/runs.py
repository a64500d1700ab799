"""Runs of a growing LZMA2 stream, as they close.

A run closes when the next chunk resets the dictionary, or the end mark comes. Only the open run is
state, so what a key keeps doesn't grow with its stream. A run is provisional until the folder's
checksum is known: `publish` joins the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUNS = "archive_id string, block_index long, run_index long, packed_offset long, packed_size long, output_offset long, output_len long, lzma_unpacked long, stored boolean, complete boolean"
STATE = "run_index long, packed_offset long, packed_size long, output_offset long, output_len long, lzma_unpacked long"


def advance(state: tuple | None, chunks: list[dict]) -> tuple[tuple | None, list[tuple]]:
    """The state after some chunks in order, and the runs that closed. A row: run_index,
    packed_offset, packed_size, output_offset, output_len, lzma_unpacked."""
    closed = []
    for c in chunks:
        ends = c["control"] == 0
        if state is not None and (ends or c["is_reset"]):
            closed.append(state)
        if ends:
            return None, closed
        if state is None:
            state = (0, c["packed_offset"], 0, 0, 0, 0)
        elif c["is_reset"]:
            state = (state[0] + 1, c["packed_offset"], 0, state[3] + state[4], 0, 0)
        lzma = 0 if c["is_stored"] else c["unpacked_len"]
        state = (state[0], state[1], state[2] + c["packed_len"], state[3], state[4] + c["unpacked_len"], state[5] + lzma)
    return state, closed


def closed_runs(chunks: DataFrame) -> DataFrame:
    """Closed runs (RUNS) of a stream of chunks (functions.lzma2.CHUNKS, with the end mark), in
    append mode. The run that is still open is not given: it may grow. The same of a batch."""
    from foldlake.sources.shipping import ship

    ship(chunks.sparkSession)

    names = [c.split()[0] for c in RUNS.split(", ")]
    if not chunks.isStreaming:
        return _closed(chunks).select(*names)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("packed_offset").to_dict("records")
        now, closed = advance(state.get if state.exists else None, rows)
        if now is None:
            state.remove()
        else:
            state.update(now)
        yield pd.DataFrame([(*key, *r, r[4] > 0 and r[5] * 64 <= r[4], True) for r in closed], columns=names)

    return chunks.groupBy("archive_id", "block_index").applyInPandasWithState(step, RUNS, STATE, "append", GroupStateTimeout.NoTimeout)


def _closed(chunks: DataFrame) -> DataFrame:
    """The same of a batch, as windows: a run is an island between resets, and closed if another chunk
    or the end mark follows it. What stands behind an end mark is another stream."""
    by = ["archive_id", "block_index"]
    order = Window.partitionBy(*by).orderBy("packed_offset")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = (F.col("control") == 0).cast("long")
    rows = chunks.withColumn("part", F.sum(ends).over(upto) - ends).withColumn("mark", F.col("control") == 0)
    own = Window.partitionBy(*by, "part").orderBy("packed_offset")
    begins = (F.row_number().over(own) == 1) | F.col("is_reset")
    rows = rows.withColumn("begins", begins.cast("long")).withColumn("run_index", F.sum(F.when(~F.col("mark"), F.col("begins")).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    last = F.max("run_index").over(Window.partitionBy(*by, "part"))
    ended = F.max("mark").over(Window.partitionBy(*by, "part"))
    rows = rows.withColumns({"last": last, "ended": ended}).where("not mark")
    runs = rows.groupBy(*by, "part", "run_index").agg(
        F.min("packed_offset").alias("packed_offset"), F.sum("packed_len").alias("packed_size"), F.sum("unpacked_len").alias("output_len"),
        F.sum(F.when(F.col("is_stored"), 0).otherwise(F.col("unpacked_len"))).cast("long").alias("lzma_unpacked"), F.first("last").alias("last"), F.first("ended").alias("ended"),
    )
    before = Window.partitionBy(*by, "part").orderBy("run_index").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("output_offset", F.coalesce(F.sum("output_len").over(before), F.lit(0)))
    stored = (F.col("output_len") > 0) & (F.col("lzma_unpacked") * 64 <= F.col("output_len"))
    return runs.where("ended or run_index < last").withColumns({"stored": stored, "complete": F.lit(True)})


def publish(runs: DataFrame, folders: DataFrame) -> DataFrame:
    """Provisional runs of folders whose checksum held (archive_id, block_index, verified), with the
    epoch of the folder's last repair. Runs of earlier epochs were replaced and don't count."""
    good = folders.where("verified").select("archive_id", "block_index", F.col("epoch").alias("final"))
    return runs.join(good, ["archive_id", "block_index"]).where("epoch = final").drop("final")


def governed_threads(progress: DataFrame, ceiling: int) -> DataFrame:
    """progress (pending_runs) with threads: one for each pending run and one more, up to a ceiling."""
    return progress.withColumn("threads", F.least(F.greatest(F.col("pending_runs") + 1, F.lit(1)), F.lit(ceiling)))


def backlog(progress: DataFrame, cap: int) -> DataFrame:
    """progress (seen, delivered) with backlog: runs seen and not delivered but for the one in work."""
    return progress.withColumn("backlog", F.least(F.greatest(F.col("seen") - F.col("delivered") - 1, F.lit(0)), F.lit(cap)))
