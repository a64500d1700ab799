"""Coder graphs of blocks: edges, validation, execution order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Coders of a block at most; also the most steps from its output to an input.
MAX_CODERS = 64


def streams(blocks: DataFrame) -> DataFrame:
    """Input streams of blocks and how they are fed. blocks: archive_id, block_index,
    coders ARRAY<STRUCT<num_in, num_out>>, bind_pairs ARRAY<STRUCT<in_index, out_index>>,
    packed_streams ARRAY. One row for each input: coder_index (its own), in_index, bound (how many
    pairs name it), packed (how often it is packed), out_index (of the pair, if any)."""
    key = ["archive_id", "block_index"]
    coders = blocks.select(*key, F.posexplode("coders").alias("coder_index", "c"), "bind_pairs", "packed_streams", "coders")
    first = F.aggregate(F.slice("coders", 1, F.col("coder_index")), F.lit(0).cast("long"), lambda a, c: a + c["num_in"])
    inputs = coders.where("c.num_in > 0").select(*key, "coder_index", F.explode(F.sequence(first, first + F.col("c.num_in") - 1)).alias("in_index"), "bind_pairs", "packed_streams")
    named = F.filter("bind_pairs", lambda p: p["in_index"] == F.col("in_index"))
    return inputs.select(
        *key, "coder_index", "in_index", F.size(named).alias("bound"),
        F.size(F.filter("packed_streams", lambda s: s == F.col("in_index"))).alias("packed"),
        F.get(named, F.lit(0))["out_index"].alias("out_index"),
    )


def edges(blocks: DataFrame) -> DataFrame:
    """archive_id, block_index, reader (the coder that reads), writer (the coder that it reads from).
    Each coder has one output, so the output's index is its writer."""
    return streams(blocks).where("out_index is not null").select("archive_id", "block_index", F.col("coder_index").alias("reader"), F.col("out_index").cast("int").alias("writer"))


def roots(blocks: DataFrame) -> DataFrame:
    """Blocks' outputs that no pair binds: archive_id, block_index, coder_index."""
    bound = F.transform("bind_pairs", lambda p: p["out_index"])
    rows = blocks.select("archive_id", "block_index", F.posexplode("coders").alias("coder_index", "c"), bound.alias("bound"))
    return rows.where(~F.exists("bound", lambda b: b == F.col("coder_index"))).drop("c", "bound")


def _longest(pairs: list[tuple[int, int]], root: list[int], steps: int) -> dict[int, int]:
    """The longest way from the roots to each coder within so many steps. pairs: (reader, writer)."""
    out: dict[int, list[int]] = {}
    for reader, writer in pairs:
        out.setdefault(reader, []).append(writer)
    found, reached = dict.fromkeys(root, 0), set(root)
    for step in range(1, steps + 1):
        reached = {w for r in reached for w in out.get(r, ())}
        if not reached:
            break
        found |= dict.fromkeys(reached, step)
    return found


def depths(blocks: DataFrame, max_depth: int = MAX_CODERS) -> DataFrame:
    """archive_id, block_index, coder_index, depth: the longest way from the block's output to each
    coder that it reaches. A coder deeper than there are coders is on a cycle. A block has 64 coders at
    most, so its graph is one row, and one pass over the blocks walks them all."""
    from foldlake.sources.shipping import ship

    ship(blocks.sparkSession)
    key = ["archive_id", "block_index"]
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    e = edges(blocks).groupBy(*key).agg(F.collect_set(F.struct("reader", "writer")).alias("pairs"))
    r = roots(blocks).groupBy(*key).agg(F.collect_set("coder_index").alias("root"))
    rows = r.join(e, key, "left").join(blocks.select(*key, F.least(F.size("coders"), F.lit(max_depth)).alias("steps")), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, coder, depth = [], [], []
            for i, row in enumerate(batch.select(["pairs", "root", "steps"]).to_pylist()):
                for c, d in _longest([(p["reader"], p["writer"]) for p in row["pairs"] or []], row["root"], row["steps"]).items():
                    at.append(i)
                    coder.append(c)
                    depth.append(d)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key[0]).take(take), batch.column(key[1]).take(take), pa.array(coder, pa.int32()), pa.array(depth, pa.int32())], [*key, "coder_index", "depth"])

    return rows.mapInArrow(run, f"archive_id {kinds['archive_id']}, block_index {kinds['block_index']}, coder_index int, depth int")


def check(blocks: DataFrame) -> DataFrame:
    """archive_id, block_index, problem (null if the graph is sound): each input bound or packed once,
    one output free, no cycle on the way from it."""
    key = ["archive_id", "block_index"]
    inputs = streams(blocks).groupBy(*key).agg(F.count_if((F.col("bound") + F.col("packed")) != 1).alias("bad_inputs"))
    free = roots(blocks).groupBy(*key).agg(F.count("*").alias("free"))
    deep = depths(blocks).groupBy(*key).agg(F.max("depth").alias("depth"))
    rows = blocks.select(*key, F.size("coders").alias("n")).join(inputs, key, "left").join(free, key, "left").join(deep, key, "left")
    problem = (
        F.when(F.col("n") == 0, "no coders")
        .when(F.coalesce("bad_inputs", F.lit(0)) > 0, "an input is bound or packed more or less than once")
        .when(F.coalesce("free", F.lit(0)) != 1, "not exactly one free output")
        .when(F.col("depth") >= F.col("n"), "a cycle")
    )
    return rows.select(*key, problem.alias("problem"))


def execution_order(blocks: DataFrame) -> DataFrame:
    """archive_id, block_index, step, coder_index: decoders from the packed streams to the output."""
    from pyspark.sql import Window

    w = Window.partitionBy("archive_id", "block_index").orderBy(F.col("depth").desc(), "coder_index")
    return depths(blocks).select("archive_id", "block_index", (F.row_number().over(w) - 1).alias("step"), "coder_index")
