"""The catalog of archives, derived from the tables that a header holds.

Every function takes and gives DataFrames, so the same code runs on parsed archives and on any
tables of the same columns (see plans.adapters). Prefix sums stand for the offsets that a reader
would keep in its head: windows partition by archive or block, and joins are equi-joins on ordinals
that these windows make, never on ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BEFORE = (Window.unboundedPreceding, -1)


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast("long"))


def pack_ranges(pack_streams: DataFrame, pack_pos: Column | None = None) -> DataFrame:
    """pack_streams with the offset of each stream (exclusive running sum) and its end."""
    w = Window.partitionBy("archive_id").orderBy("pack_index").rowsBetween(*BEFORE)
    offset = _zero(F.sum("size").over(w)) + (pack_pos if pack_pos is not None else F.lit(0))
    return pack_streams.withColumn("offset", offset).withColumn("end", F.col("offset") + F.col("size"))


def block_firsts(blocks: DataFrame) -> DataFrame:
    """blocks (num_packed, num_sub_streams) with the first pack stream and first sub-stream of each."""
    w = Window.partitionBy("archive_id").orderBy("block_index").rowsBetween(*BEFORE)
    return blocks.withColumns({"first_pack": _zero(F.sum("num_packed").over(w)), "first_sub_stream": _zero(F.sum("num_sub_streams").over(w))})


def explicit_sub_streams(blocks: DataFrame, counts: DataFrame | None) -> DataFrame:
    """blocks with num_sub_streams: as counted, or one each where the section is missing."""
    if counts is None:
        return blocks.withColumn("num_sub_streams", F.lit(1))
    named = counts.select("archive_id", "block_index", "num_sub_streams")
    return blocks.drop("num_sub_streams").join(named, ["archive_id", "block_index"], "left").withColumn("num_sub_streams", F.coalesce("num_sub_streams", F.lit(1)))


def residual_sizes(sub_streams: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sub-streams with all sizes: a block's last one is what its size leaves (null, and over_sum,
    where the others are larger than the block). sub_streams: archive_id, block_index, ordinal,
    size (null for the last); blocks: archive_id, block_index, unpack_size."""
    key = ["archive_id", "block_index"]
    own = Window.partitionBy(*key)
    rows = sub_streams.join(blocks.select(*key, "unpack_size"), key)
    last = F.row_number().over(own.orderBy(F.col("ordinal").desc())) == 1
    rows = rows.withColumn("is_last", last)
    others = _zero(F.sum(F.when(~F.col("is_last"), F.col("size"))).over(own))
    rows = rows.withColumn("over_sum", others > F.col("unpack_size"))
    rest = F.when(~F.col("over_sum"), F.col("unpack_size") - others)
    return rows.withColumn("size", F.when(F.col("is_last"), rest).otherwise(F.col("size"))).drop("unpack_size")


def inherited_crcs(sub_streams: DataFrame, blocks: DataFrame) -> DataFrame:
    """A block's only sub-stream has the block's CRC where it has none of its own."""
    key = ["archive_id", "block_index"]
    rows = sub_streams.join(blocks.select(*key, F.col("crc").alias("block_crc"), "num_sub_streams"), key)
    return rows.withColumn("crc", F.coalesce("crc", F.when(F.col("num_sub_streams") == 1, F.col("block_crc")))).drop("block_crc", "num_sub_streams")


def file_blocks(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """entries with stream_index (ordinal among those with a stream), block_index and position in the
    block; a file without a stream lies in a block only where files of that block stand on both sides
    of it.

    entries: archive_id, file_index, has_stream; blocks: archive_id, block_index, num_sub_streams.
    The n-th stream belongs to the n-th sub-stream, so one row for each sub-stream makes this an
    equi-join."""
    order = Window.partitionBy("archive_id").orderBy("file_index")
    running = F.sum(F.col("has_stream").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = entries.withColumn("stream_index", F.when(F.col("has_stream"), running - 1))
    firsts = Window.partitionBy("archive_id").orderBy("block_index").rowsBetween(*BEFORE)
    streams = blocks.withColumn("first", _zero(F.sum("num_sub_streams").over(firsts))).where("num_sub_streams > 0")
    streams = streams.select("archive_id", "block_index", "first", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("num_sub_streams") - 1)).alias("stream_index"))
    rows = rows.join(streams.select("archive_id", "stream_index", F.col("block_index").alias("own"), (F.col("stream_index") - F.col("first")).alias("position")), ["archive_id", "stream_index"], "left")
    before = F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # backwards, as a frame that ends with the partition is worked out anew for each row
    back = Window.partitionBy("archive_id").orderBy(F.col("file_index").desc())
    after = F.last("own", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("block_index", F.when(before == after, before)).drop("own")


def stream_count_check(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Archives whose files with streams and sub-streams differ in number: archive_id, files, streams."""
    files = entries.groupBy("archive_id").agg(F.sum(F.col("has_stream").cast("long")).alias("files"))
    streams = blocks.groupBy("archive_id").agg(F.sum("num_sub_streams").alias("streams"))
    both = files.join(streams, "archive_id", "full").select("archive_id", _zero(F.col("files")).alias("files"), _zero(F.col("streams")).alias("streams"))
    return both.where("files <> streams")


def member_offsets(members: DataFrame) -> DataFrame:
    """Members of blocks (archive_id, block_index, file_index, size) with their offset in the block."""
    w = Window.partitionBy("archive_id", "block_index").orderBy("file_index").rowsBetween(*BEFORE)
    return members.withColumn("unpacked_offset", _zero(F.sum("size").over(w)))


def block_spans(mapped: DataFrame) -> DataFrame:
    """First and last file of each block, and how many lie in it."""
    return mapped.where("block_index is not null").groupBy("archive_id", "block_index").agg(F.min("file_index").alias("first_file"), F.max("file_index").alias("last_file"), F.count("*").alias("files"))


def walk_order(mapped: DataFrame) -> DataFrame:
    """Rows with walk_index: block by block, then those that lie in none."""
    w = Window.partitionBy("archive_id").orderBy(F.col("block_index").asc_nulls_last(), F.col("file_index"))
    return mapped.withColumn("walk_index", F.row_number().over(w) - 1)


def block_pack_ranges(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """The pack streams of each block: the interval of its prefix sums, as an equi-join on ordinals."""
    firsts = block_firsts(blocks).where("num_packed > 0")
    each = firsts.select("archive_id", "block_index", F.explode(F.sequence(F.col("first_pack"), F.col("first_pack") + F.col("num_packed") - 1)).alias("pack_index"))
    return each.join(ranges, ["archive_id", "pack_index"])


def compressed_sizes(mapped: DataFrame, block_packs: DataFrame) -> DataFrame:
    """A block's packed bytes, at its first file; 0 at the others."""
    packed = block_packs.groupBy("archive_id", "block_index").agg(F.sum("size").alias("packed"))
    first = F.row_number().over(Window.partitionBy("archive_id", "block_index").orderBy(F.col("stream_index").asc_nulls_last(), "file_index")) == 1
    rows = mapped.join(packed, ["archive_id", "block_index"], "left")
    return rows.withColumn("compressed_size", F.when(F.col("block_index").isNotNull() & first & F.col("has_stream"), _zero(F.col("packed"))).otherwise(F.lit(0).cast("long"))).drop("packed")


def solid(blocks: DataFrame) -> DataFrame:
    """archive_id, is_solid: whether a block holds more than one sub-stream; and their number."""
    return blocks.groupBy("archive_id").agg(F.bool_or(F.col("num_sub_streams") > 1).alias("is_solid"), F.sum("num_sub_streams").cast("long").alias("num_sub_streams"))


def summary(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each archive: entries, blocks, bytes, bytes of names, entries with a CRC."""
    of_entries = entries.groupBy("archive_id").agg(
        F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.sum(F.octet_length("name")).cast("long").alias("name_bytes"), F.count("crc").alias("crcs")
    )
    of_blocks = blocks.groupBy("archive_id").agg(F.count("*").alias("blocks"))
    return of_entries.join(of_blocks, "archive_id", "left").withColumn("blocks", _zero(F.col("blocks")))


def last_by_name(entries: DataFrame, *by: str) -> DataFrame:
    """The row that a lookup by name gives: of equal names the last. One aggregate, no sort."""
    rest = [c for c in entries.columns if c not in by]
    return entries.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col("file_index")).alias("x")).select(*by, "x.*")


def methods_of(mapped: DataFrame, coders: DataFrame) -> DataFrame:
    """archive_id, file_index, methods: names of the coders of a file's block in order, without
    unknown ones. coders: archive_id, block_index, coder_index, method (null if unknown)."""
    known = coders.where("method is not null")
    lists = known.groupBy("archive_id", "block_index").agg(F.sort_array(F.collect_list(F.struct("coder_index", "method"))).alias("x"))
    return mapped.join(lists, ["archive_id", "block_index"]).select("archive_id", "file_index", F.col("x.method").alias("methods"))


def raw_copy(blocks: DataFrame, entries: DataFrame, sub_streams: DataFrame, rename: Column) -> DataFrame:
    """What a copy of whole packed blocks holds: each entry with a stream under its new name, for
    blocks whose entries and sub-streams are as many and all have a CRC. No byte is decoded."""
    key = ["archive_id", "block_index"]
    counted = entries.where("has_stream").groupBy(*key).agg(F.count("*").alias("files"))
    checked = sub_streams.groupBy(*key).agg(F.count("*").alias("streams"), F.count("crc").alias("crcs"))
    good = blocks.join(counted, key).join(checked, key).where("files = streams and crcs = streams")
    return entries.where("has_stream").join(good.select(*key), key, "left_semi").withColumn("name", rename)
