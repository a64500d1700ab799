"""Driver tables in the columns of the catalog, so that its functions run on them as on parsed
archives. The tables are analogies: an order is a block, a line item a sub-stream, a customer an
archive, a part a coder, a document or page a member with bytes, an event a chunk or progress record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer: archive_id, block_index (the order), unpack_size, num_sub_streams,
    num_packed."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").alias("archive_id"), F.col("o_orderkey").alias("block_index"), F.floor("o_totalprice").cast("long").alias("unpack_size"),
        (F.col("o_orderkey") % 4).alias("num_sub_streams"), (F.col("o_orderkey") % 3 + 1).alias("num_packed"),
    )


def pack_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("archive_id"), F.col("o_orderkey").alias("pack_index"), F.floor("o_totalprice").cast("long").alias("size"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct line items of an order: archive_id (the customer), block_index, file_index, size."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = items.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("archive_id"), F.col("l_orderkey").alias("block_index"), F.col("l_linenumber").cast("long").alias("file_index"), "size")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members: archive_id (the source), file_index, name, size, crc, has_stream."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("archive_id"), F.col("doc_id").alias("file_index"), F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 5 != 0, F.lit(1).cast("long")).alias("crc"), (F.col("doc_id") % 7 != 0).alias("has_stream"), "text", "lang",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as chunks of a stream; a signup resets the dictionary, an error is stored."""
    events = table(spark, sf_dir, "events")
    size = F.floor(F.col("value") * 100).cast("long")
    return events.select(
        F.col("user_id").alias("archive_id"), F.col("event_id").alias("packed_offset"), (F.col("event_type") == "signup").alias("is_reset"), (F.col("event_type") == "error").alias("is_stored"),
        (size + 6).alias("packed_len"), (size * 3 + 1).alias("unpacked_len"), "event_type", "ts",
    )


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as benchmark runs: the month is the scenario, the status the variant (O the candidate),
    the priority the host."""
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return orders.select(
        F.date_format("o_orderdate", "MM").alias("scenario"), status.alias("variant"), F.lit("orders").alias("group"),
        F.when(F.month("o_orderdate") % 2 == 0, "encode").otherwise("decode").alias("op"),
        F.when(status == "O", "candidate").when(status == "F", "reference").otherwise("secondary").alias("role"),
        (F.col("o_orderkey") % 10 == 0).alias("warmup"), F.when(F.col("o_orderkey") % 17 == 0, "failed").otherwise("ok").alias("status"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("wall_seconds"), (F.col("o_custkey") + 1).cast("double").alias("user_seconds"), F.lit(1.0).alias("sys_seconds"),
        (F.col("o_custkey") * 1024 + 4096).alias("max_rss_bytes"), (F.col("o_orderkey") % 8).cast("double").alias("load_average"),
        (F.col("o_orderkey") * 10 + 1).alias("bytes_in"), (F.col("o_custkey") * 7 + 3).alias("bytes_out"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit("timed out")).alias("failure"), F.concat(F.lit("x"), (F.col("o_orderkey") % 3).cast("string")).alias("extra"),
        F.col("o_orderpriority").alias("host"),
    )


def row_index(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
