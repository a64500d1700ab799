"""Queries over the catalog, on driver tables that stand for it, each with its SQL.

`QUERIES` holds (name, query, SQL) with None where SQL can't express the query (codecs, the parser,
streams); those are held against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldlake.functions import attributes, paths, sizes
from foldlake.operators import benchstats, catalog, graph, integrity, limits, memory, planner
from foldlake.plans import adapters, codec_queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f, sql
        return f

    return add


def _unsafe(name: str) -> str:
    return f"""CASE WHEN {name} = '' THEN 'the entry has no name'
        WHEN contains({name}, chr(0)) THEN 'the name contains a NUL'
        WHEN {name} LIKE '/%' OR {name} LIKE '\\%' THEN 'the name is an absolute path'
        ELSE list_filter(list_transform(regexp_split_to_array({name}, '[/\\\\]'), lambda c: CASE WHEN c = '..' THEN 'the name walks out of the extraction directory'
            WHEN regexp_matches(c, '^[A-Za-z]:') THEN 'the name names a drive' END), lambda x: x IS NOT NULL)[1] END"""


@query(f"""
    SELECT source AS archive_id, count(*) AS entries, sum(strlen(text))::BIGINT AS bytes, sum(strlen('docs/' || lang || '/' || doc_id || '.txt'))::BIGINT AS name_bytes,
        count(*) FILTER (doc_id % 5 <> 0) AS crcs, count(*) FILTER ({_unsafe("'docs/' || lang || '/' || doc_id || '.txt'")} IS NOT NULL) AS unsafe_names
    FROM documents GROUP BY source""")
def entry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, F1: what a listing of each archive sums up."""
    return adapters.entries(spark, sf_dir).groupBy("archive_id").agg(
        F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.sum(F.octet_length("name")).cast("long").alias("name_bytes"), F.count("crc").alias("crcs"),
        F.count_if(paths.is_unsafe_path(F.col("name"))).alias("unsafe_names"),
    )


_NAMES = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN '/' || url WHEN 2 THEN 'a/../' || url WHEN 3 THEN 'a/C:/..' WHEN 4 THEN 'a\\..\\' || url
    WHEN 5 THEN '' WHEN 6 THEN 'x' || chr(0) || 'y' ELSE 'plain/./' || page_id || '.html' END AS name FROM pages"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id") % 8, F.col("url")
    name = (
        F.when(k == 0, url).when(k == 1, F.concat(F.lit("/"), url)).when(k == 2, F.concat(F.lit("a/../"), url)).when(k == 3, F.lit("a/C:/.."))
        .when(k == 4, F.concat(F.lit("a\\..\\"), url)).when(k == 5, F.lit("")).when(k == 6, F.lit("x\0y")).otherwise(F.concat(F.lit("plain/./"), F.col("page_id").cast("string"), F.lit(".html")))
    )
    return adapters.table(spark, sf_dir, "pages").select("page_id", name.alias("name"))


@query(f"""SELECT page_id, {_unsafe("name")} AS reason,
    CASE WHEN {_unsafe("name")} IS NULL AND len(list_filter(regexp_split_to_array(name, '[/\\\\]'), lambda c: c <> '' AND c <> '.')) > 0
        THEN array_to_string(list_filter(regexp_split_to_array(name, '[/\\\\]'), lambda c: c <> '' AND c <> '.'), '/') END AS path FROM ({_NAMES})""")
def unsafe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """why a name is unsafe, and the path of one that is safe."""
    name = F.col("name")
    return _names(spark, sf_dir).select("page_id", paths.unsafe_path_reason(name).alias("reason"), paths.safe_path(name).alias("path"))


@query(f"""SELECT archive_id, file_index, name, reason FROM (SELECT page_id % 7 AS archive_id, page_id AS file_index, name, {_unsafe("name")} AS reason,
    row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS rn FROM ({_NAMES}) WHERE {_unsafe("name")} IS NOT NULL) WHERE rn = 1""")
def first_unsafe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry for which an archive is refused."""
    rows = _names(spark, sf_dir).select((F.col("page_id") % 7).alias("archive_id"), F.col("page_id").alias("file_index"), "name")
    return limits.unsafe_names(rows)


_CRC = """WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t)
    SELECT item_id, strlen(text) AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) AS crc32 FROM benchmark, t"""


@query(_CRC)
def member_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F23."""
    rows = adapters.table(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.octet_length("text").cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("crc32"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def content_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22."""
    return adapters.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


_MEMBERS = """(SELECT o_custkey AS archive_id, l_orderkey AS block_index, l_linenumber::BIGINT AS file_index, sum(l_quantity::BIGINT)::BIGINT AS size
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
_BLOCKS = """(SELECT o_custkey AS archive_id, o_orderkey AS block_index, floor(o_totalprice)::BIGINT AS unpack_size, o_orderkey % 4 AS num_sub_streams, o_orderkey % 3 + 1 AS num_packed FROM orders)"""


@query(f"""SELECT archive_id, block_index, file_index, size, coalesce(sum(size) OVER (PARTITION BY archive_id, block_index ORDER BY file_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS unpacked_offset
    FROM {_MEMBERS}""")
def sub_stream_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return catalog.member_offsets(adapters.members(spark, sf_dir))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY archive_id, block_index ORDER BY file_index DESC) = 1 AS is_last FROM {_MEMBERS}),
    x AS (SELECT s.archive_id, s.block_index, s.file_index, s.size, is_last, unpack_size % 200 AS total, coalesce(sum(CASE WHEN NOT is_last THEN s.size END) OVER (PARTITION BY s.archive_id, s.block_index), 0)::BIGINT AS others
        FROM s JOIN {_BLOCKS} b USING (archive_id, block_index))
    SELECT archive_id, block_index, file_index AS ordinal, CASE WHEN NOT is_last THEN size WHEN others <= total THEN total - others END AS size, is_last, others > total AS over_sum FROM x""")
def residual_last_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes but the last are stored, the last is what is left."""
    streams = adapters.members(spark, sf_dir).withColumnRenamed("file_index", "ordinal")
    blocks = adapters.blocks(spark, sf_dir).select("archive_id", "block_index", (F.col("unpack_size") % 200).alias("unpack_size"))
    return catalog.residual_sizes(streams, blocks).select("archive_id", "block_index", "ordinal", "size", "is_last", "over_sum")


_FILES = """(SELECT user_id AS archive_id, event_id AS file_index, event_type <> 'error' AS has_stream FROM events)"""
_FILE_BLOCKS = """(SELECT user_id AS archive_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS block_index, 1 + event_id % 3 AS num_sub_streams FROM events WHERE event_id % 3 = 0 OR event_type = 'view')"""
_MAPPED = f"""WITH f AS (SELECT *, CASE WHEN has_stream THEN sum(has_stream::INT) OVER (PARTITION BY archive_id ORDER BY file_index) - 1 END::BIGINT AS stream_index FROM {_FILES}),
    b AS (SELECT *, coalesce(sum(num_sub_streams) OVER (PARTITION BY archive_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM {_FILE_BLOCKS}),
    m AS (SELECT f.*, b.block_index AS own, f.stream_index - b.first AS position FROM f LEFT JOIN b ON f.archive_id = b.archive_id AND f.stream_index >= b.first AND f.stream_index < b.first + b.num_sub_streams),
    z AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY archive_id ORDER BY file_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b0,
        first_value(own IGNORE NULLS) OVER (PARTITION BY archive_id ORDER BY file_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b1 FROM m),
    mapped AS (SELECT archive_id, file_index, has_stream, stream_index, position, CASE WHEN b0 = b1 THEN b0 END AS block_index FROM z)"""


def _file_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = adapters.table(spark, sf_dir, "events")
    files = events.select(F.col("user_id").alias("archive_id"), F.col("event_id").alias("file_index"), (F.col("event_type") != "error").alias("has_stream"))
    some = events.where((F.col("event_id") % 3 == 0) | (F.col("event_type") == "view"))
    blocks = adapters.row_index(some.select(F.col("user_id").alias("archive_id"), "event_id", (1 + F.col("event_id") % 3).alias("num_sub_streams")), "archive_id", "event_id", "block_index")
    return files, blocks.select("archive_id", F.col("block_index").cast("long").alias("block_index"), "num_sub_streams")


@query(_MAPPED + " SELECT archive_id, file_index, has_stream, stream_index, position, block_index FROM mapped")
def file_block_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which block each file lies in."""
    return catalog.file_blocks(*_file_tables(spark, sf_dir)).select("archive_id", "file_index", "has_stream", "stream_index", "position", "block_index")


@query(_MAPPED + " SELECT archive_id, block_index, min(file_index) AS first_file, max(file_index) AS last_file, count(*) AS files FROM mapped WHERE block_index IS NOT NULL GROUP BY ALL")
def block_file_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    return catalog.block_spans(catalog.file_blocks(*_file_tables(spark, sf_dir)))


@query(_MAPPED + " SELECT archive_id, file_index, block_index, row_number() OVER (PARTITION BY archive_id ORDER BY block_index NULLS LAST, file_index) - 1 AS walk_index FROM mapped")
def entry_walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    rows = catalog.walk_order(catalog.file_blocks(*_file_tables(spark, sf_dir)))
    return rows.select("archive_id", "file_index", "block_index", F.col("walk_index").cast("long").alias("walk_index"))


@query(f"""SELECT coalesce(f.archive_id, b.archive_id) AS archive_id, coalesce(files, 0)::BIGINT AS files, coalesce(streams, 0)::BIGINT AS streams
    FROM (SELECT archive_id, sum(has_stream::INT) AS files FROM {_FILES} GROUP BY 1) f FULL JOIN (SELECT archive_id, sum(num_sub_streams) AS streams FROM {_FILE_BLOCKS} GROUP BY 1) b ON f.archive_id = b.archive_id
    WHERE coalesce(files, 0) <> coalesce(streams, 0)""")
def stream_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives whose files and sub-streams are not as many."""
    return catalog.stream_count_check(*_file_tables(spark, sf_dir))


_RANGES = """(SELECT o_custkey AS archive_id, o_orderkey AS pack_index, floor(o_totalprice)::BIGINT AS size,
    (coalesce(sum(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 32)::BIGINT AS "offset" FROM orders)"""


@query(f"""SELECT archive_id, pack_index, size, "offset", "offset" + size AS "end" FROM {_RANGES}""")
def pack_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, F9."""
    return catalog.pack_ranges(adapters.pack_streams(spark, sf_dir), F.lit(32))


@query(f"""SELECT archive_id, block_index, num_packed, num_sub_streams,
    coalesce(sum(num_packed) OVER w, 0)::BIGINT AS first_pack, coalesce(sum(num_sub_streams) OVER w, 0)::BIGINT AS first_sub_stream
    FROM {_BLOCKS} WINDOW w AS (PARTITION BY archive_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def block_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    return catalog.block_firsts(adapters.blocks(spark, sf_dir)).drop("unpack_size")


_PACKS = f"""p AS (SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY block_index, k) - 1 AS pack_index, unpack_size + k AS size FROM {_BLOCKS}, range(3) r(k) WHERE k < num_packed),
    q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY archive_id ORDER BY pack_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM p),
    b AS (SELECT *, coalesce(sum(num_packed) OVER (PARTITION BY archive_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_pack FROM {_BLOCKS})"""


@query(f"""WITH {_PACKS} SELECT b.archive_id, b.block_index, min("offset") AS "offset", sum(size)::BIGINT AS packed, count(*) AS streams FROM b JOIN q ON b.archive_id = q.archive_id
    AND pack_index >= first_pack AND pack_index < first_pack + num_packed GROUP BY ALL""")
def block_pack_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed bytes of each block."""
    blocks = adapters.blocks(spark, sf_dir)
    streams = blocks.select("archive_id", "block_index", "unpack_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_packed") - 1)).alias("k"))
    streams = adapters.row_index(streams.withColumn("at", F.struct("block_index", "k")), "archive_id", "at", "pack_index").select("archive_id", "pack_index", (F.col("unpack_size") + F.col("k")).alias("size"))
    found = catalog.block_pack_ranges(blocks, catalog.pack_ranges(streams))
    return found.groupBy("archive_id", "block_index").agg(F.min("offset").alias("offset"), F.sum("size").alias("packed"), F.count("*").alias("streams"))


@query(f"SELECT archive_id, bool_or(num_sub_streams > 1) AS is_solid, sum(num_sub_streams)::BIGINT AS num_sub_streams FROM {_BLOCKS} GROUP BY archive_id")
def is_solid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3."""
    return catalog.solid(adapters.blocks(spark, sf_dir))


_METHODS = ["COPY", "LZMA2", "PPMD", "BZIP2", "ZSTD", "LIZARD", "DELTA", "LZ4"]
_MEMORY = "CASE p_partkey % 8 WHEN 0 THEN 0 WHEN 1 THEN (2 + p_size % 2) * (1::BIGINT << (p_size // 2 % 14 + 11)) + 1048576 WHEN 2 THEN p_size * 65536::BIGINT + 1048576 WHEN 3 THEN 8388608 WHEN 4 THEN 167772160 WHEN 6 THEN 1048576 WHEN 7 THEN 16777216 END"


def _coders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as coders, their method by the part."""
    items = adapters.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    parts = adapters.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    owners = adapters.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    method = F.get(F.array(*map(F.lit, _METHODS)), (F.col("p_partkey") % 8).cast("int"))
    size = F.col("p_size").cast("long")
    prop = size % 2 + F.floor(size / 2) % 14 * 2
    little = F.unhex(F.concat(F.lit("06"), F.lpad(F.hex(F.lit(0)), 4, "0"), F.lpad(F.hex(size % 256), 2, "0"), F.lit("00")))
    properties = F.when(method == "LZMA2", F.unhex(F.lpad(F.hex(prop), 2, "0"))).when(method == "PPMD", little).otherwise(F.lit(b""))
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("archive_id"), F.col("l_orderkey").alias("block_index"), F.col("l_linenumber").alias("coder_index"), "l_partkey", method.alias("method"), properties.alias("properties"))


_BLOCK_MEMORY = f"""(SELECT o_custkey AS archive_id, l_orderkey AS block_index, CASE WHEN count(*) = count(m) THEN (sum(m) + 65536)::BIGINT END AS bytes
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, o_custkey, {_MEMORY} AS m FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) GROUP BY ALL)"""


@query(f"SELECT archive_id, block_index, bytes FROM {_BLOCK_MEMORY}")
def block_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum over a block's coders."""
    return memory.block_memory(_coders(spark, sf_dir))


@query(f"SELECT archive_id, CASE WHEN count(*) = count(bytes) THEN max(bytes) END AS resident_bytes FROM {_BLOCK_MEMORY} GROUP BY archive_id")
def decoder_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the largest block; unknown if one is."""
    return memory.decoder_memory(_coders(spark, sf_dir))


@query("""SELECT o_custkey AS archive_id, sum(w) FILTER (rw <= 4)::BIGINT AS lent_windows, sum(b) FILTER (rb <= 4)::BIGINT AS lent_bytes FROM (SELECT o_custkey, o_orderkey % 5 AS w, floor(o_totalprice)::BIGINT AS b,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, o_orderkey) AS rw, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice) DESC, o_orderkey) AS rb FROM orders) GROUP BY 1""")
def lent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W15, O2."""
    rows = adapters.blocks(spark, sf_dir).select("archive_id", "block_index", (F.col("block_index") % 5).alias("windows"), F.col("unpack_size").alias("bytes"))
    return memory.lent(rows, 4)


_ADMISSION = """(SELECT o_custkey AS archive_id, count(*) * 10 AS entries, count(*) AS blocks, sum(o_orderkey % 3 + 1)::BIGINT AS pack_streams, sum(o_orderkey % 4)::BIGINT AS coders,
    sum(floor(o_totalprice)::BIGINT)::BIGINT AS unpack_bytes, sum(o_orderkey)::BIGINT AS packed_bytes FROM orders GROUP BY 1)"""


@query(f"""SELECT archive_id, v.l AS "limit", v.a AS allowed, v.r AS requested FROM (SELECT archive_id, CASE WHEN entries > 150 THEN {{'l': 'Entries', 'a': 150::BIGINT, 'r': entries}}
    WHEN blocks > 14 THEN {{'l': 'Blocks', 'a': 14::BIGINT, 'r': blocks}} WHEN pack_streams > 24 THEN {{'l': 'PackStreams', 'a': 24::BIGINT, 'r': pack_streams}} WHEN coders > 18 THEN {{'l': 'TotalCoders', 'a': 18::BIGINT, 'r': coders}}
    WHEN unpack_bytes > 2000000 THEN {{'l': 'UnpackBytes', 'a': 2000000::BIGINT, 'r': unpack_bytes}}
    WHEN packed_bytes <> 0 AND unpack_bytes > 30 * packed_bytes THEN {{'l': 'UnpackRatio', 'a': 30::BIGINT, 'r': (unpack_bytes + packed_bytes - 1) // packed_bytes}} END AS v FROM {_ADMISSION})""")
def limit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first limit that an archive violates, in the order of the checks."""
    rows = adapters.blocks(spark, sf_dir).groupBy("archive_id").agg(
        (F.count("*") * 10).alias("entries"), F.count("*").alias("blocks"), F.sum("num_packed").alias("pack_streams"), F.sum("num_sub_streams").alias("coders"), F.sum("unpack_size").alias("unpack_bytes"), F.sum("block_index").alias("packed_bytes"),
    )
    bounds = limits.ArchiveLimits(max_entries=150, max_blocks=14, max_pack_streams=24, max_total_coders=18, max_unpack_bytes=2_000_000, max_unpack_ratio=30)
    return limits.archive_violations(rows, bounds).select("archive_id", "violation.limit", "violation.allowed", "violation.requested")


@query("""SELECT c AS archive_id, len AS length, e AS packed_end FROM (SELECT o_custkey AS c, 2000000 + o_custkey * 100 AS len, (o_custkey % 7 + sum(floor(o_totalprice)::BIGINT) + 32)::BIGINT AS e FROM orders GROUP BY 1) WHERE e > len""")
def pack_beyond_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    archives = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("archive_id"), (F.col("c_custkey") * 100 + 2_000_000).alias("length"), (F.col("c_custkey") % 7).alias("pack_pos"))
    return limits.packed_beyond_file(archives, adapters.pack_streams(spark, sf_dir))


@query("""SELECT l_orderkey AS block_index, u AS unpacked, p AS packed, CASE WHEN p = 0 THEN 0 ELSE (u + p - 1) // p END AS ratio, p <> 0 AND u > 900 * p AS exceeds
    FROM (SELECT l_orderkey, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS u, sum(l_quantity::BIGINT - 1)::BIGINT AS p FROM lineitem GROUP BY 1)""")
def unpack_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, F11."""
    rows = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block_index")).agg(F.sum(F.floor("l_extendedprice").cast("long")).alias("unpacked"), F.sum(F.col("l_quantity").cast("long") - 1).alias("packed"))
    u, p = F.col("unpacked"), F.col("packed")
    return rows.select("block_index", "unpacked", "packed", sizes.unpack_ratio(u, p).alias("ratio"), sizes.unpack_ratio_exceeds(u, p, F.lit(900)).alias("exceeds"))


_PLAN = """b AS (SELECT *, unpack_size <= 250000 AS small FROM {blocks}),
    r AS (SELECT *, sum((NOT small OR NOT coalesce(lag_small, false))::INT) OVER (PARTITION BY {by} ORDER BY block_index) AS run FROM (SELECT *, lag(small) OVER (PARTITION BY {by} ORDER BY block_index) AS lag_small FROM b)),
    g AS (SELECT {by}, run, min(block_index) AS first_block, max(block_index) AS last_block, count(*) AS blocks, least(4, count(*), {cap})::BIGINT AS workers FROM r GROUP BY {by}, run),
    phases AS (SELECT {by}, first_block, last_block, blocks, workers, {each} AS threads_each, true AS parallel FROM g WHERE blocks >= 2 AND workers >= 2
        UNION ALL SELECT {rby}, block_index, block_index, 1, 1, 4, false FROM r JOIN g USING ({by}, run) WHERE NOT (blocks >= 2 AND workers >= 2))"""
_PHASE = "(row_number() OVER (PARTITION BY archive_id ORDER BY first_block) - 1)::INT AS phase"


@query("WITH " + _PLAN.format(blocks=_BLOCKS, by="archive_id", rby="archive_id", cap="4", each="greatest(1, 4 // workers)") + f" SELECT archive_id, first_block, last_block, blocks, workers, threads_each, parallel, {_PHASE} FROM phases")
def folder_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of small blocks side by side, large ones alone."""
    return planner.plan_folders(adapters.blocks(spark, sf_dir).withColumn("memory", F.lit(0).cast("long")), 4, stage=250_000)


@query("WITH " + _PLAN.format(blocks=_BLOCKS, by="archive_id", rby="archive_id", cap="(63 * 1048576) // (max(unpack_size) * 16 + 17891328)", each="1") + f" SELECT archive_id, first_block, last_block, blocks, workers, threads_each, parallel, {_PHASE} FROM phases")
def folder_plan_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 under a memory limit: each worker is charged the largest decoder of its run."""
    return planner.plan_folders(adapters.blocks(spark, sf_dir).withColumn("memory", F.col("unpack_size") * 16), 4, 64 << 20, stage=250_000)


_SINGLE = f"(SELECT *, num_sub_streams <= 1 AS single, unpack_size % 2 = 0 AS one_run FROM {_BLOCKS})"


@query(f"""WITH i AS (SELECT *, sum((single IS DISTINCT FROM lag_single)::INT) OVER (PARTITION BY archive_id ORDER BY block_index) AS stretch FROM (SELECT *, lag(single) OVER (PARTITION BY archive_id ORDER BY block_index) AS lag_single FROM {_SINGLE})),
    u AS (SELECT archive_id, stretch, min(block_index) AS first_block, max(block_index) AS last_block, count(*) AS blocks, bool_and(single) AS single, bool_and(one_run) AS one_run, least(4, count(*)) AS workers FROM i GROUP BY 1, 2),
    """ + _PLAN.format(blocks="(SELECT i.* FROM i JOIN u USING (archive_id, stretch) WHERE NOT (u.single AND u.blocks >= 2))", by="archive_id, stretch", rby="archive_id, stretch", cap="4", each="greatest(1, 4 // workers)") + f"""
    SELECT *, {_PHASE} FROM (SELECT archive_id, first_block, last_block, blocks, workers::BIGINT AS workers, CASE WHEN one_run THEN 1 ELSE greatest(1, 4 // workers) END::BIGINT AS threads_each, 'unordered' AS kind FROM u WHERE single AND blocks >= 2
    UNION ALL SELECT archive_id, first_block, last_block, blocks, workers, threads_each, CASE WHEN parallel THEN 'parallel' ELSE 'alone' END FROM phases)""")
def unordered_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    blocks = adapters.blocks(spark, sf_dir).withColumns({"memory": F.lit(0).cast("long"), "single": F.col("num_sub_streams") <= 1, "one_run": F.col("unpack_size") % 2 == 0})
    return planner.plan_unordered(blocks, 4, stage=250_000)


@query("""WITH RECURSIVE d AS (SELECT source AS archive_id, doc_id AS file_index, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    f AS (SELECT archive_id, file_index, rn, size AS held, 0::BIGINT AS bin FROM d WHERE rn = 1
        UNION ALL SELECT d.archive_id, d.file_index, d.rn, CASE WHEN held + size >= 20000 THEN size ELSE held + size END, CASE WHEN held + size >= 20000 THEN bin + 1 ELSE bin END FROM f JOIN d ON d.archive_id = f.archive_id AND d.rn = f.rn + 1)
    SELECT archive_id, file_index, bin FROM f""")
def solid_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10, W-12: which solid block each file goes into."""
    return planner.solid_bins(adapters.entries(spark, sf_dir).select("archive_id", "file_index", "size"), 20_000)


_CHUNKS = """(SELECT user_id AS archive_id, event_id AS packed_offset, event_type = 'signup' AS is_reset, event_type = 'error' AS is_stored, floor(value * 100)::BIGINT + 6 AS packed_len, floor(value * 100)::BIGINT * 3 + 1 AS unpacked_len FROM events)"""
_RUNS = f"""(SELECT archive_id, run_index, count(*) AS chunks, sum(packed_len)::BIGINT AS packed, sum(unpacked_len)::BIGINT AS unpacked, sum(CASE WHEN is_stored THEN 0 ELSE unpacked_len END)::BIGINT AS lzma_unpacked
    FROM (SELECT *, (sum(is_reset::INT) OVER (PARTITION BY archive_id ORDER BY packed_offset) - 1)::BIGINT AS run_index FROM {_CHUNKS}) GROUP BY 1, 2)"""


@query(f"SELECT *, unpacked > 0 AND lzma_unpacked * 64 <= unpacked AS stored FROM {_RUNS}")
def run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a stream and their shapes."""
    return planner.run_shapes(adapters.chunks(spark, sf_dir), ("archive_id",))


@query(f"SELECT archive_id, count(*) AS runs, max(unpacked) AS largest, min(unpacked) AS smallest, sum(chunks)::BIGINT AS chunks, count(*) FILTER (unpacked > 0 AND lzma_unpacked * 64 <= unpacked) AS stored_runs FROM {_RUNS} GROUP BY 1")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    return planner.run_statistics(planner.run_shapes(adapters.chunks(spark, sf_dir), ("archive_id",)))


@query(f"SELECT archive_id, run_index, max(packed) OVER w AS max_packed, max(unpacked) OVER w AS max_unpacked FROM {_RUNS} WINDOW w AS (PARTITION BY archive_id ORDER BY run_index ROWS 7 PRECEDING)")
def run_shape_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13."""
    shapes = planner.run_shapes(adapters.chunks(spark, sf_dir), ("archive_id",))
    return planner.shape_window(shapes, ("archive_id",)).select("archive_id", "run_index", "max_packed", "max_unpacked")


@query(f"""WITH RECURSIVE r AS (SELECT archive_id, run_index, unpacked % 3 = 0 AS f, row_number() OVER (PARTITION BY archive_id ORDER BY run_index) AS rn FROM {_RUNS}),
    h AS (SELECT archive_id, run_index, rn, false AS state, CASE WHEN f THEN 1 ELSE 0 END AS streak FROM r WHERE rn = 1
        UNION ALL SELECT r.archive_id, r.run_index, r.rn, CASE WHEN f <> state AND streak >= 1 THEN f ELSE state END, CASE WHEN f = state OR streak >= 1 THEN 0 ELSE streak + 1 END FROM h JOIN r ON r.archive_id = h.archive_id AND r.rn = h.rn + 1)
    SELECT archive_id, run_index, state AS dense FROM h""")
def run_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state that follows the second disagreeing run."""
    shapes = planner.run_shapes(adapters.chunks(spark, sf_dir), ("archive_id",)).withColumn("flag", F.col("unpacked") % 3 == 0)
    return planner.hysteresis(shapes, ("archive_id",), flag="flag")


_TILES = f"""(SELECT archive_id, run_index - min(run_index) OVER (PARTITION BY archive_id) AS run_index, packed, unpacked,
    (coalesce(sum(packed) OVER w, 0) + CASE WHEN archive_id % 5 = 0 AND run_index = 3 THEN 1 ELSE 0 END)::BIGINT AS pk, coalesce(sum(unpacked) OVER w, 0)::BIGINT AS ou FROM {_RUNS}
    WINDOW w AS (PARTITION BY archive_id ORDER BY run_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""SELECT archive_id, bool_and(run_index = rn - 1 AND ou = coalesce(lo, 0) AND pk = coalesce(lp, 0)) AS tiles, count(*) AS runs, max(ou + unpacked) AS output_end, max(pk + packed) AS packed_end
    FROM (SELECT *, row_number() OVER w AS rn, lag(ou + unpacked) OVER w AS lo, lag(pk + packed) OVER w AS lp FROM {_TILES} WINDOW w AS (PARTITION BY archive_id ORDER BY ou, run_index)) GROUP BY 1""")
def run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether completed runs tile their stream."""
    from pyspark.sql import Window

    shapes = planner.run_shapes(adapters.chunks(spark, sf_dir), ("archive_id",))
    w = Window.partitionBy("archive_id").orderBy("run_index").rowsBetween(*catalog.BEFORE)
    shift = F.when((F.col("archive_id") % 5 == 0) & (F.col("run_index") == 3), 1).otherwise(0)
    runs = shapes.select(
        "archive_id", (F.col("run_index") - F.min("run_index").over(Window.partitionBy("archive_id"))).alias("run_index"),
        (F.coalesce(F.sum("packed").over(w), F.lit(0)) + shift).cast("long").alias("packed_offset"), F.col("packed").alias("packed_size"), F.coalesce(F.sum("unpacked").over(w), F.lit(0)).cast("long").alias("output_offset"), F.col("unpacked").alias("output_len"),
    )
    return planner.coverage(runs, ("archive_id",))


@query("""SELECT archive_id, wave, sum(c)::BIGINT AS runs FROM (SELECT user_id AS archive_id, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS wave, event_id % 3 AS c FROM events) GROUP BY ALL""")
def run_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14."""
    rows = adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("archive_id"), "event_id", (F.col("event_type") == "view").alias("waits"), (F.col("event_id") % 3).alias("claimed"))
    return planner.waves(rows, ("archive_id",), "event_id")


@query("""WITH RECURSIVE b AS (SELECT n_nationkey AS k, n_regionkey AS r, 2 + n_nationkey % 3 AS n FROM nation), e AS (SELECT k, i AS reader, CASE WHEN r = 2 AND i = n - 1 THEN 0 ELSE i + 1 END AS writer, r, n FROM b, range(5) t(i) WHERE i < n - 1 OR (r = 2 AND i = n - 1)),
    w AS (SELECT k, 0 AS coder, 0 AS depth, n FROM b UNION ALL SELECT w.k, e.writer, depth + 1, w.n FROM w JOIN e ON w.k = e.k AND w.coder = e.reader WHERE depth < w.n)
    SELECT b.r::BIGINT AS archive_id, b.k::BIGINT AS block_index, CASE WHEN b.r = 1 THEN 'an input is bound or packed more or less than once' WHEN b.r = 2 THEN 'not exactly one free output' WHEN max(depth) >= b.n THEN 'a cycle' END AS problem FROM b JOIN w ON b.k = w.k GROUP BY b.r, b.k, b.n""")
def graph_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of coders of nations; region 1 packs an input twice, region 2 binds its last
    coder to the first output."""
    n = F.col("n")
    one = F.struct(F.lit(1).cast("long").alias("num_in"), F.lit(1).cast("long").alias("num_out"))
    pair = lambda i: F.struct(i.cast("long").alias("in_index"), (i + 1).cast("long").alias("out_index"))
    back = F.array(F.struct((n - 1).cast("long").alias("in_index"), F.lit(0).cast("long").alias("out_index")))
    rows = adapters.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("archive_id"), F.col("n_nationkey").cast("long").alias("block_index"), (F.lit(2) + F.col("n_nationkey") % 3).alias("n"))
    last = (n - 1).cast("long")
    blocks = rows.select(
        "archive_id", "block_index", F.array_repeat(one, n).alias("coders"),
        F.when(F.col("archive_id") == 2, F.concat(F.transform(F.sequence(F.lit(0), n - 2), pair), back)).otherwise(F.transform(F.sequence(F.lit(0), n - 2), pair)).alias("bind_pairs"),
        F.when(F.col("archive_id") == 1, F.array(last, last)).when(F.col("archive_id") == 2, F.array().cast("array<long>")).otherwise(F.array(last)).alias("packed_streams"),
    )
    return graph.check(blocks)


@query("SELECT source, lang, file_index, size FROM (SELECT source, lang, doc_id AS file_index, strlen(text) AS size, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1")
def name_index_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal names the last."""
    rows = adapters.entries(spark, sf_dir).select(F.col("archive_id").alias("source"), "lang", "file_index", "size")
    return catalog.last_by_name(rows, "source", "lang")


@query("SELECT doc_id, e AS expected, a AS actual FROM (SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN strlen(text) + l.toxic END AS e, strlen(text) AS a FROM documents d JOIN labels l USING (doc_id)) WHERE e <> a")
def crc_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and computed digests that differ."""
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("crc"))
    labels = adapters.table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.when(F.col("quality").isNotNull(), F.col("crc") + F.col("toxic")).alias("crc"))
    return integrity.verify(labels, docs, "doc_id")


@query("""WITH g AS (SELECT doc_id, count(*) AS n, min(crc) AS lo FROM (SELECT doc_id, n_chars AS crc FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 = 1) GROUP BY 1),
    w AS (SELECT l.doc_id, n_chars + toxic AS crc FROM labels l JOIN documents USING (doc_id))
    SELECT * FROM (SELECT coalesce(g.doc_id, w.doc_id) AS doc_id, CASE WHEN w.doc_id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN lo IS DISTINCT FROM crc THEN 'mismatch' END AS problem FROM g FULL JOIN w ON g.doc_id = w.doc_id) WHERE problem IS NOT NULL""")
def reported_vs_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("crc"))
    reported = docs.where("doc_id % 3 <> 0").unionByName(docs.where("doc_id % 10 = 1"))
    expected = adapters.table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", (F.col("crc") + F.col("toxic")).alias("crc"))
    return integrity.reported_against_expected(reported, expected, "doc_id")


@query("""SELECT fixture, seq, digest, first_digest FROM (SELECT user_id AS fixture, event_id AS seq, event_type AS digest, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS first_digest FROM events) WHERE digest <> first_digest""")
def digest_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13."""
    rows = adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("fixture"), F.col("event_id").alias("seq"), F.col("event_type").alias("digest"))
    return integrity.digest_agreement(rows)


@query(f"""WITH m AS (SELECT *, CASE WHEN file_index <> 7 THEN size END AS crc FROM {_MEMBERS}), good AS (SELECT archive_id, block_index FROM m GROUP BY 1, 2 HAVING count(*) = count(crc))
    SELECT m.archive_id, m.block_index, m.file_index, 'copy/' || m.archive_id || '/' || m.file_index AS name, m.size FROM m SEMI JOIN good USING (archive_id, block_index)""")
def raw_copy_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-7, J8: entries of blocks that can be copied as they are, under new names."""
    rows = adapters.members(spark, sf_dir).withColumns({"has_stream": F.lit(True), "crc": F.when(F.col("file_index") != 7, F.col("size"))})
    name = F.concat(F.lit("copy/"), F.col("archive_id").cast("string"), F.lit("/"), F.col("file_index").cast("string"))
    blocks = rows.select("archive_id", "block_index").distinct()
    return catalog.raw_copy(blocks, rows, rows.select("archive_id", "block_index", "crc"), name).select("archive_id", "block_index", "file_index", "name", "size")


@query("""SELECT file_index, archive_id, methods FROM (SELECT d.doc_id AS file_index, d.source AS archive_id, string_agg(p_type, ',' ORDER BY p_partkey) FILTER (p_type <> 'SMALL') AS methods
    FROM documents d JOIN part ON p_partkey // 4 = d.doc_id % (SELECT max(p_partkey) // 4 + 1 FROM part) GROUP BY 1, 2) WHERE methods IS NOT NULL""")
def methods_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the known coders of a file's block."""
    part = adapters.table(spark, sf_dir, "part")
    blocks = part.agg(F.floor(F.max("p_partkey") / 4) + 1).scalar()
    files = adapters.entries(spark, sf_dir).select("archive_id", "file_index", (F.col("file_index") % blocks).alias("block_index"))
    method = F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    coders = part.select(F.floor(F.col("p_partkey") / 4).alias("block_index"), F.col("p_partkey").alias("coder_index"), method.alias("method"))
    coders = coders.join(files.select("archive_id", "block_index").distinct(), "block_index")
    found = catalog.methods_of(files, coders)
    return found.select("file_index", "archive_id", F.array_join("methods", ",").alias("methods"))


_BENCH = """(SELECT strftime(o_orderdate, '%m') AS scenario, o_orderstatus AS variant, CASE WHEN month(o_orderdate) % 2 = 0 THEN 'encode' ELSE 'decode' END AS op,
    CASE o_orderstatus WHEN 'O' THEN 'candidate' WHEN 'F' THEN 'reference' ELSE 'secondary' END AS role, o_orderkey % 10 = 0 AS warmup, CASE WHEN o_orderkey % 17 = 0 THEN 'failed' ELSE 'ok' END AS status,
    o_orderkey AS seq, o_totalprice AS wall, (o_custkey + 2)::DOUBLE AS cpu, (o_custkey * 1024 + 4096)::DOUBLE AS rss, o_orderkey * 10 + 1 AS bytes_in, o_custkey * 7 + 3 AS bytes_out, o_orderpriority AS host FROM orders)"""
_SUMMARY = f"""(SELECT scenario, variant, any_value(op) AS op, any_value(role) AS role, median(wall) FILTER (status = 'ok') AS wall, min(wall) FILTER (status = 'ok') AS wall_min, max(wall) FILTER (status = 'ok') AS wall_max, count(*) FILTER (status = 'ok') AS n,
    median(cpu) FILTER (status = 'ok') AS cpu, median(rss) FILTER (status = 'ok') AS rss, max_by(bytes_in, seq) FILTER (status = 'ok') AS bytes_in, round(median(bytes_out) FILTER (status = 'ok'))::BIGINT AS bytes_out, count(*) FILTER (status = 'failed') AS failed
    FROM {_BENCH} WHERE NOT (warmup AND status = 'ok') GROUP BY 1, 2)"""


@query(f"""SELECT scenario, variant, round(wall, 4) AS wall, wall_min, wall_max, n, round(cpu, 4) AS cpu, round(rss, 4) AS rss, bytes_in, bytes_out, failed,
    round(CASE WHEN op = 'encode' THEN bytes_in ELSE bytes_out END / 1048576.0 / wall, 9) AS throughput FROM {_SUMMARY}""")
def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A11, A12, P8."""
    s = benchstats.summarize(adapters.bench_runs(spark, sf_dir))
    return s.select(
        "scenario", "variant", F.round("wall.median", 4).alias("wall"), F.col("wall.min").alias("wall_min"), F.col("wall.max").alias("wall_max"), F.col("wall.n").alias("n"),
        F.round("cpu.median", 4).alias("cpu"), F.round("rss.median", 4).alias("rss"), "bytes_in", "bytes_out", "failed", F.round("throughput_mib_s", 9).alias("throughput"),
    )


@query(f"""SELECT c.scenario, c.variant, r.variant AS reference, round(r.wall / c.wall, 6) AS wall, round(r.cpu / c.cpu, 6) AS cpu, round(r.rss / c.rss, 6) AS rss, CASE WHEN c.op = 'encode' THEN round(r.bytes_out::DOUBLE / c.bytes_out, 6) END AS size
    FROM {_SUMMARY} c JOIN {_SUMMARY} r ON c.scenario = r.scenario WHERE c.role = 'candidate' AND r.role <> 'candidate'""")
def bench_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, A13, F29."""
    r = benchstats.ratios(benchstats.summarize(adapters.bench_runs(spark, sf_dir)))
    return r.select("scenario", "variant", "reference", *[F.round(x, 6).alias(x) for x in ("wall", "cpu", "rss", "size")])


_HOST_RATIOS = f"""(SELECT host, op AS category, variant, scenario, median(wall) / 1000 AS wall FROM {_BENCH} GROUP BY ALL)"""


def _host_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.bench_runs(spark, sf_dir).groupBy("host", F.col("op").alias("category"), "variant", "scenario").agg((F.median("wall_seconds") / 1000).alias("wall"))


@query(f"""SELECT category, variant, round(exp(avg(ln(m))), 6) AS mean, count(*) AS hosts FROM (SELECT category, variant, host, exp(avg(ln(wall))) AS m, string_agg(scenario, ',' ORDER BY scenario) AS s FROM {_HOST_RATIOS} GROUP BY ALL)
    GROUP BY 1, 2 HAVING count(DISTINCT s) = 1 AND count(*) = (SELECT count(DISTINCT host) FROM {_HOST_RATIOS})""")
def geomean_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only where all hosts have the same scenarios."""
    found = benchstats.geomeans_by_category(_host_ratios(spark, sf_dir))
    return found.select("category", "variant", F.round("mean", 6).alias("mean"), "hosts")


@query(f"SELECT scenario, count(DISTINCT host) = (SELECT count(DISTINCT host) FROM {_HOST_RATIOS}) AS common FROM {_HOST_RATIOS} GROUP BY 1")
def common_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1."""
    return benchstats.common_scenarios(_host_ratios(spark, sf_dir))


@query("""SELECT * FROM (SELECT coalesce(x.k, y.k) AS key, x.v AS a, y.v AS b, x.k IS NOT NULL AS ia, y.k IS NOT NULL AS ib FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0) x
    FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 0) y ON x.k = y.k) EXCLUDE (ia, ib) WHERE a IS DISTINCT FROM b OR ia <> ib""".replace("SELECT * FROM (", "SELECT key, a, b FROM (", 1).replace(") EXCLUDE (ia, ib) WHERE", ") WHERE"))
def workload_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: missing is not the same as null."""
    rows = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    other = rows.where("key % 7 <> 0").withColumn("value", F.when(F.col("key") % 5 != 0, F.col("value")))
    return benchstats.workload_difference(rows.where("key % 3 <> 0"), other)


@query("""SELECT scenario, variant, coalesce(max(v) FILTER (host = 'A')::VARCHAR, '-') AS "A", coalesce(max(v) FILTER (host = 'N')::VARCHAR, '-') AS "N", coalesce(max(v) FILTER (host = 'R')::VARCHAR, '-') AS "R"
    FROM (SELECT l_suppkey AS scenario, l_linestatus AS variant, l_returnflag AS host, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY ALL) GROUP BY 1, 2""")
def host_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    items = adapters.table(spark, sf_dir, "lineitem")
    rows = items.groupBy(F.col("l_suppkey").alias("scenario"), F.col("l_linestatus").alias("variant"), F.col("l_returnflag").alias("host")).agg(F.sum(F.col("l_quantity").cast("long")).alias("wall"))
    return benchstats.host_pivot(rows, ["A", "N", "R"])


@query("""SELECT host, scenario, variant, ratio, rank FROM (SELECT l_returnflag AS host, l_suppkey AS scenario, l_linestatus AS variant, r AS ratio, (row_number() OVER (PARTITION BY l_returnflag ORDER BY r IS NULL, r, l_suppkey, l_linestatus))::INT AS rank
    FROM (SELECT l_returnflag, l_suppkey, l_linestatus, CASE WHEN l_suppkey % 9 > 0 THEN sum(l_quantity::BIGINT)::DOUBLE / count(*) END AS r FROM lineitem GROUP BY l_returnflag, l_suppkey, l_linestatus)) WHERE rank <= 5 AND ratio IS NOT NULL""")
def worst5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3, W16."""
    items = adapters.table(spark, sf_dir, "lineitem")
    ratio = F.when(F.col("scenario") % 9 > 0, F.sum(F.col("l_quantity").cast("long")).cast("double") / F.count("*"))
    rows = items.groupBy(F.col("l_returnflag").alias("host"), F.col("l_suppkey").alias("scenario"), F.col("l_linestatus").alias("variant")).agg(ratio.alias("ratio"))
    return benchstats.worst(rows).select("host", "scenario", "variant", "ratio", "rank")


@query("""SELECT id, sum(w)::BIGINT AS slept, sum(w * greatest(8 - k, 0))::BIGINT AS idle, CASE WHEN sum(w * k) > 0 AND sum(w) > 0 THEN round(sum(w * k)::DOUBLE / sum(w)::DOUBLE, 6) END AS mean_busy
    FROM (SELECT vec_id AS id, unnest(range(len(embedding))) AS k, floor(abs(unnest(embedding)::DOUBLE) * 1000)::BIGINT AS w FROM embeddings) GROUP BY 1""")
def ledger_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that threads had no run, out of a histogram by runs out."""
    waits = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("long"))
    rows = adapters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("threads"), waits.alias("waits"))
    return benchstats.ledger_idle(rows).withColumn("mean_busy", F.round("mean_busy", 6))


@query("""SELECT user_id AS reader, max(value) AS peak, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY 1""")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    rows = adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("reader"), F.col("value").alias("peak"), F.floor("value").cast("long").alias("total"))
    return benchstats.accumulate_ledgers(rows, ["peak"], ["total"])


@query("""WITH i AS (SELECT user_id, event_id, event_type, sum((event_type IS DISTINCT FROM p OR rn = 1)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))),
    t AS (SELECT user_id, island, any_value(event_type) AS v, count(*) AS n FROM i GROUP BY 1, 2)
    SELECT user_id, string_agg(CASE WHEN island > 24 THEN '...' WHEN n > 1 THEN v || 'x' || n ELSE v END, ' ' ORDER BY island) AS folded FROM t WHERE island <= 25 GROUP BY 1""")
def wave_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """equal neighbours folded, 24 terms at most."""
    return benchstats.run_lengths(adapters.table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS tags FROM events GROUP BY 1")
def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    rows = adapters.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tag"))
    return benchstats.source_tags(rows, "user_id")


@query("""SELECT o_orderkey, ((epoch_us(o_orderdate) + 11644473600000000) * 10)::DECIMAL(20,0) AS ticks, o_orderdate + INTERVAL (o_orderkey % 1000) MICROSECOND AS back FROM orders""")
def nt_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: ticks of a date, and back with some more of them."""
    rows = adapters.table(spark, sf_dir, "orders").select("o_orderkey", attributes.ticks(F.col("o_orderdate").cast("timestamp")).cast("decimal(20,0)").alias("ticks"))
    more = F.col("ticks") + (F.col("o_orderkey") % 1000 * 10 + 7).cast("decimal(20,0)")
    return rows.select("o_orderkey", "ticks", attributes.timestamp(more).cast("timestamp_ntz").alias("back"))


_ATTR = "(o_orderkey * 7919 % 4294967296)"


@query(f"""SELECT o_orderkey, CASE WHEN ({_ATTR} & 32768) <> 0 THEN ({_ATTR} >> 16) & 65535 END AS unix_mode, (({_ATTR} & 32768) <> 0 AND (({_ATTR} >> 16) & 61440) = 40960) OR ({_ATTR} & 1024) <> 0 AS is_symlink FROM orders""")
def entry_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4."""
    attr = F.col("o_orderkey") * 7919 % F.lit(1 << 32)
    return adapters.table(spark, sf_dir, "orders").select("o_orderkey", attributes.unix_mode(attr).alias("unix_mode"), attributes.is_symlink(attr).alias("is_symlink"))


@query("SELECT o_orderkey, CASE WHEN x < 128 THEN 1 WHEN x < 16384 THEN 2 WHEN x < 2097152 THEN 3 WHEN x < 268435456 THEN 4 WHEN x < 34359738368 THEN 5 WHEN x < 4398046511104 THEN 6 ELSE 7 END AS n FROM (SELECT o_orderkey, o_orderkey * o_orderkey * (o_orderkey % 100) AS x FROM orders)")
def varint_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a number takes."""
    k = F.col("o_orderkey")
    return adapters.table(spark, sf_dir, "orders").select("o_orderkey", sizes.varint_length(k * k * (k % 100)).alias("n"))


@query("""SELECT p_partkey, CASE WHEN c = 40 THEN 4294967295 WHEN c < 40 THEN (2 + c % 2) * (1::BIGINT << (c // 2 + 11)) END AS dictionary, least(CASE WHEN c = 40 THEN 4294967295 WHEN c < 40 THEN (2 + c % 2) * (1::BIGINT << (c // 2 + 11)) END, greatest(p_partkey * 1000, 4096)) AS clamped,
    (greatest(least(greatest((2 + c % 20 % 2) * (1::BIGINT << (c % 20 // 2 + 11)) * 4, 1048576), 268435456), (2 + c % 20 % 2) * (1::BIGINT << (c % 20 // 2 + 11))) + 1048575) // 1048576 * 1048576 AS run_cap FROM (SELECT p_partkey, p_partkey % 42 AS c FROM part)""")
def lzma2_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, F14, F17."""
    c = F.col("p_partkey") % 42
    d = sizes.lzma2_dictionary_of(c)
    clamped = F.when(d.isNotNull(), sizes.clamp_dictionary(d, F.col("p_partkey") * 1000)).otherwise(F.greatest(F.col("p_partkey") * 1000, F.lit(4096)))
    return adapters.table(spark, sf_dir, "part").select("p_partkey", d.alias("dictionary"), clamped.alias("clamped"), sizes.encoder_run_cap(sizes.lzma2_dictionary_of(c % 20)).alias("run_cap"))


@query("""SELECT o_custkey AS archive_id, CASE WHEN min(s) = 0 THEN NULL ELSE sum(s)::BIGINT END AS declared FROM (SELECT o_custkey, o_orderkey % 97 AS s FROM orders) GROUP BY 1""")
def declared_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F28."""
    rows = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("archive_id")).agg(F.collect_list(F.col("o_orderkey") % 97).alias("s"))
    return rows.select("archive_id", sizes.declared_folder_size(F.col("s")).alias("declared"))


@query("""SELECT archive_id, sum(CASE WHEN power = 63 THEN 0 ELSE 1::BIGINT << power END)::BIGINT AS rounds FROM (SELECT DISTINCT o_custkey AS archive_id, CASE WHEN o_orderkey % 5 = 0 THEN 63 ELSE o_orderkey % 20 END AS power, o_orderstatus AS salt FROM orders) GROUP BY 1""")
def kdf_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each derivation once."""
    k = F.col("o_orderkey")
    rows = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive_id"), F.lit("AES256_SHA256").alias("method"), F.when(k % 5 == 0, 63).otherwise(k % 20).alias("power"), F.col("o_orderstatus").alias("salt"))
    return limits.kdf_rounds(rows)


@query("""SELECT event_id, CASE WHEN c IN ('Cancelled', 'Internal') THEN c WHEN c IN ('Corrupted', 'ChecksumMismatch') AND aes THEN 'Password' WHEN c IN ('ChecksumMismatch', 'Corrupted') THEN c WHEN c = 'UnsupportedMethod' THEN c ELSE 'Io' END AS kind
    FROM (SELECT event_id, event_id % 2 = 0 AS aes, CASE event_type WHEN 'view' THEN 'Corrupted' WHEN 'click' THEN 'ChecksumMismatch' WHEN 'error' THEN 'Internal' WHEN 'signup' THEN 'UnsupportedMethod' ELSE 'Interrupted' END AS c FROM events)""")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 2.9: what an error in a block counts as."""
    t = F.col("event_type")
    code = F.when(t == "view", "Corrupted").when(t == "click", "ChecksumMismatch").when(t == "error", "Internal").when(t == "signup", "UnsupportedMethod").otherwise("Interrupted")
    rows = adapters.table(spark, sf_dir, "events").select("event_id", code.alias("code"), (F.col("event_id") % 2 == 0).alias("block_has_aes"))
    return integrity.classify(rows).select("event_id", "kind")


@query("SELECT user_id AS archive_id, event_id AS block_index, event_type AS code FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type IN ('error', 'view')) WHERE rn = 1")
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of the first failing block in archive order."""
    rows = adapters.table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view")).select(F.col("user_id").alias("archive_id"), F.col("event_id").alias("block_index"), F.col("event_type").alias("code"))
    return integrity.first_error(rows)


@query("""SELECT p_type AS scenario, pass::INT AS pass, (row_number() OVER (PARTITION BY p_type, pass ORDER BY CASE WHEN pass % 2 = 0 THEN i ELSE -i END) - 1)::INT AS position, variant
    FROM (SELECT p_type, p_brand AS variant, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS i FROM (SELECT DISTINCT p_type, p_brand FROM part)), range(3) r(pass)""")
def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """odd passes backwards."""
    rows = adapters.table(spark, sf_dir, "part").select(F.col("p_type").alias("scenario"), F.col("p_brand").alias("variant")).distinct()
    return benchstats.run_order(adapters.row_index(rows, "scenario", "variant", "variant_index"), 3)


@query("SELECT DISTINCT variant, first_seen FROM (SELECT event_type AS variant, min(event_id) AS first_seen FROM events GROUP BY 1 UNION SELECT 'label ' || label, min(vec_id) FROM embeddings GROUP BY label)")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of keys, each at its first place."""
    events = adapters.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant")).agg(F.min("event_id").alias("first_seen"))
    labels = adapters.table(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("label "), F.col("label").cast("string")).alias("variant")).agg(F.min("vec_id").alias("first_seen"))
    return events.union(labels).distinct()


@query("""SELECT user_id AS archive_id, count(*) AS checked, sum((event_type <> 'error')::INT)::BIGINT AS published, min(event_id) FILTER (event_type = 'error') AS first_failed FROM events GROUP BY 1""")
def completion_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of completions publishes, as one batch."""
    from foldlake.streaming import completions

    rows = adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("archive_id"), F.col("event_id").alias("block_index"), (F.col("event_type") != "error").alias("verified"))
    return completions.published(rows)


@query("""WITH c AS (SELECT user_id, event_id, event_type, floor(value * 100)::BIGINT AS v, sum((event_type = 'signup' OR rn = 1)::INT) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)),
    r AS (SELECT user_id, run, min(event_id) AS packed_offset, sum(v + 6)::BIGINT AS packed_size, sum(v * 3 + 1)::BIGINT AS output_len, sum(CASE WHEN event_type = 'error' THEN 0 ELSE v * 3 + 1 END)::BIGINT AS lzma FROM c GROUP BY 1, 2)
    SELECT user_id::VARCHAR AS archive_id, run::BIGINT AS run_index, packed_offset, packed_size, coalesce(sum(output_len) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS output_offset, output_len, lzma * 64 <= output_len AS stored
    FROM r QUALIFY run < max(run) OVER (PARTITION BY user_id)""")
def closed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stateful scan gives of a stream whose last run is still open, as one batch."""
    from foldlake.streaming import runs

    rows = adapters.chunks(spark, sf_dir)
    rows = rows.select(
        F.col("archive_id").cast("string").alias("archive_id"), F.lit(0).cast("long").alias("block_index"), "packed_offset", F.when(F.col("is_reset"), 1).otherwise(2).alias("control"), F.lit(3).alias("header_len"),
        "packed_len", "unpacked_len", "is_reset", "is_stored",
    )
    return runs.closed_runs(rows).select("archive_id", "run_index", "packed_offset", "packed_size", "output_offset", "output_len", "stored")


@query("""SELECT event_id, least(greatest(s - d - 1, 0), 12)::BIGINT AS backlog, least(greatest(p + 1, 1), 6)::BIGINT AS threads FROM (SELECT event_id, event_id % 40 AS s, event_id % 23 AS d, event_id % 9 AS p FROM events)""")
def progress_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backlog of a decode, and the threads a governor gives it."""
    from foldlake.streaming import runs

    k = F.col("event_id")
    rows = adapters.table(spark, sf_dir, "events").select("event_id", (k % 40).alias("seen"), (k % 23).alias("delivered"), (k % 9).alias("pending_runs"))
    return runs.governed_threads(runs.backlog(rows, 12), 6).select("event_id", "backlog", "threads")


_SCENARIOS = f"""(SELECT p_partkey AS seq, p_brand AS host, {benchstats.GROUPS + ["stored", "own group"]}[p_partkey % 16 + 1] AS grp,
    ['encode/payload-sub/', 'encode/tree-nonsolid/', 'decode/tree/', 'decode/non-solid/'][p_size % 4 + 1] || p_partkey || CASE WHEN p_size % 5 = 0 THEN '/stream' ELSE '' END AS id,
    ['decode', 'encode', 'list'][p_partkey % 3 + 1] AS op, CASE WHEN p_size % 2 = 0 THEN '1' ELSE 'all' END AS threads, p_size % 7 = 0 AS adaptive, CASE WHEN p_size % 11 = 0 THEN 1024 ELSE 0 END AS memory_limit FROM part)"""


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scenarios of a benchmark; the brand is the host."""
    k, n = F.col("p_partkey"), F.col("p_size")
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    return adapters.table(spark, sf_dir, "part").select(
        k.alias("seq"), F.col("p_brand").alias("host"), pick([*benchstats.GROUPS, "stored", "own group"], k % 16).alias("group"),
        F.concat(pick(["encode/payload-sub/", "encode/tree-nonsolid/", "decode/tree/", "decode/non-solid/"], n % 4), k.cast("string"), F.when(n % 5 == 0, "/stream").otherwise("")).alias("id"),
        pick(["decode", "encode", "list"], k % 3).alias("op"), F.when(n % 2 == 0, "1").otherwise("all").alias("threads"), (n % 7 == 0).alias("adaptive"), F.when(n % 11 == 0, 1024).otherwise(0).alias("memory_limit"),
    )


@query(f"""SELECT id AS scenario, CASE WHEN op = 'encode' THEN 'encode' ELSE 'decode' END AS chart,
    CASE WHEN grp = 'container parse' THEN 'Listing' ELSE CASE WHEN suffix(id, '/stream') THEN 'Streamed extract' WHEN grp IN ('lzma2 single-stream', 'lzma2 parallel', 'lzma2 near-incompressible') THEN 'LZMA2' WHEN grp = 'lzma' THEN 'LZMA'
        WHEN grp = 'encode' AND prefix(id, 'encode/payload-sub/') THEN 'LZMA2' WHEN grp IN ('encode', 'solid vs non-solid') THEN CASE WHEN regexp_matches(id, 'non-?solid') THEN 'Non-solid trees' ELSE 'Solid trees' END
        WHEN grp = 'stored' THEN 'Stored' WHEN grp IN ('aes-256', 'encode aes-256') THEN 'AES-256' WHEN grp = 'filters' THEN 'BCJ / BCJ2 / delta' WHEN grp = 'ppmd (secondary)' THEN 'PPMd' WHEN grp = 'encode bcj2' THEN 'BCJ2' ELSE grp END
        || CASE WHEN threads = '1' THEN ', 1 thread' ELSE ', multi-thread' END END AS category,
    grp IN ('memory budget', 'decode ledger') OR adaptive OR memory_limit <> 0 AS excluded,
    CASE WHEN op <> 'list' AND grp <> 'memory budget' AND NOT adaptive AND memory_limit = 0 THEN 'All ' || op END AS headline, contains(id, 'tree') AS asked FROM {_SCENARIOS}""")
def chart_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scenario's chart and bars, whether it is left out, whether it is asked for."""
    rows = _scenarios(spark, sf_dir)
    asked = benchstats.only(rows, ["tree"]).select("id", F.lit(True).alias("asked"))
    group, flags = F.col("group"), (F.col("adaptive"), F.col("memory_limit"))
    return rows.join(asked, "id", "left").select(
        F.col("id").alias("scenario"), benchstats.chart_op(F.col("op")).alias("chart"), benchstats.category(group, F.col("id"), F.col("threads")).alias("category"),
        benchstats.excluded(group, *flags).alias("excluded"), benchstats.headline(group, F.col("op"), *flags).alias("headline"), F.coalesce("asked", F.lit(False)).alias("asked"),
    )


@query(f"""SELECT host, id, (row_number() OVER (PARTITION BY host ORDER BY greatest(coalesce(list_position({benchstats.GROUPS}, grp), 0), 1), seq) - 1)::INT AS position FROM {_SCENARIOS}""")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups as they are declared, rows of a group as they were seen."""
    return benchstats.in_group_order(_scenarios(spark, sf_dir), "host", "seq").select("host", "id", "position")


@query("""SELECT chart, category, position::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY head DESC, CASE WHEN has AND NOT head THEN coalesce(mean, 0) END DESC NULLS LAST, first_seen) - 1 AS position
    FROM (SELECT *, max(head) OVER (PARTITION BY chart) AS has FROM (SELECT *, category = 'All ' || chart AS head
        FROM (SELECT p_brand AS chart, CASE WHEN p_type = 'SMALL' AND p_brand > 'Brand#2' THEN 'All ' || p_brand ELSE p_type || p_size % 4 END AS category, min(p_partkey) AS first_seen, max(p_size) FILTER (p_size % 4 > 0)::DOUBLE AS mean FROM part GROUP BY 1, 2))))""")
def chart_bar_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars best first, the headline before all; a chart without it as first seen."""
    name = F.when((F.col("p_type") == "SMALL") & (F.col("p_brand") > "Brand#2"), F.concat(F.lit("All "), "p_brand")).otherwise(F.concat("p_type", (F.col("p_size") % 4).cast("string")))
    rows = adapters.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("chart"), name.alias("category"))
    bars = rows.agg(F.min("p_partkey").alias("first_seen"), F.max(F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("double"))).alias("mean"))
    return benchstats.chart_order(bars).select("chart", "category", "position")


def _number(i: int) -> str:
    return f"(o_orderkey * {i + 3} + o_custkey) % {97 + i}"


_STATS = ", ".join(f"round(coalesce(median({x}), 0), 6) AS {x}_median, round(coalesce(min({x}), 0)::DOUBLE, 6) AS {x}_min, round(coalesce(max({x}), 0)::DOUBLE, 6) AS {x}_max, count({x}) AS {x}_n" for x in [*benchstats.LEDGER_SERIES, *benchstats.LEDGER_DERIVED])
_NUMBERS = {x: _number(i) for i, x in enumerate([*benchstats.LEDGER_MAXIMA, *benchstats.LEDGER_SERIES])}
_WAITS = "[o_orderkey % 5 * 1000000000, o_orderkey % 3 * 500000000, o_custkey % 4 * 250000000]"


@query(f"""SELECT scenario, variant, {", ".join(f"max({x})::BIGINT AS {x}" for x in benchstats.LEDGER_MAXIMA)}, {_STATS}, array_to_string(min_by(held, seq), ',') AS held
    FROM (SELECT *, least(dictionaries, chase_bytes) AS touched, dictionary_bytes * (worker_threads + (chase_bytes > 0)::INT) AS nominal, rss - peak_total_bytes - dictionaries AS remainder,
        CASE WHEN wave_count > 0 THEN runs::DOUBLE / wave_count END AS runs_per_wave, (held[1] + held[2] + held[3]) / 1e9 AS wait_seconds,
        (held[1] * greatest(threads, 0) + held[2] * greatest(threads - 1, 0) + held[3] * greatest(threads - 2, 0)) / 1e9 AS idle_worker_seconds,
        CASE WHEN held[1] + held[2] + held[3] > 0 THEN round((held[2] + 2 * held[3])::DOUBLE / (held[1] + held[2] + held[3]), 9) END AS mean_runs_out_asleep
        FROM (SELECT o_orderpriority AS scenario, o_orderstatus AS variant, o_orderkey AS seq, o_custkey * 1024 + 4096 AS rss, {", ".join(f"{v} AS {k}" for k, v in _NUMBERS.items())}, {_WAITS} AS held,
            CASE WHEN {_NUMBERS["chase_bytes"]} > 0 THEN {_NUMBERS["dictionary_bytes"]} ELSE 0 END AS dictionaries FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 6 <> 0)) GROUP BY 1, 2""")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a scenario and variant over its runs that went well and have one."""
    numbers = [F.expr(v).alias(f"ledger_{k}") for k, v in _NUMBERS.items()]
    waits = F.expr(f"array{_WAITS.replace('[', '(').replace(']', ')')}")
    runs = adapters.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("variant"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 17 == 0, "failed").otherwise("ok").alias("status"),
        (F.col("o_custkey") * 1024 + 4096).alias("max_rss_bytes"), (F.col("o_orderkey") % 6).alias("ledger_blocks"), *numbers, waits.alias("ledger_wave_runs"), waits.alias("ledger_wave_runs_out"), waits.alias("ledger_wait_nanos_by_runs_out"),
    )
    found = benchstats.ledger_summary(runs)
    stats = [(F.col(f"{x}.n") if part == "n" else F.round(f"{x}.{part}", 6)).alias(f"{x}_{part}") for x in [*benchstats.LEDGER_SERIES, *benchstats.LEDGER_DERIVED] for part in ("median", "min", "max", "n")]
    return found.select("scenario", "variant", *benchstats.LEDGER_MAXIMA, *stats, F.array_join(F.col("wave_runs").cast("array<string>"), ",").alias("held"))


_LEVEL = "p_partkey % 11"
_LISTS = {"d": sizes.LEVEL_DICTIONARY, "n": sizes.LEVEL_NICE_LENGTH}


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN w ELSE least(w, greatest(p_partkey * 1000, 4096)) END AS dictionary, {_LISTS["n"]}[least({_LEVEL}, 9) + 1]::INT AS nice_length, CASE WHEN {_LEVEL} < 4 THEN {sizes.LEVEL_DEPTH}[{_LEVEL} + 1]::INT END AS depth,
    CASE WHEN {_LEVEL} > 3 AND p_size % 4 > 1 THEN 2 ELSE 1 END AS threads, CASE WHEN {_LEVEL} <= 1 THEN 100000 WHEN {_LEVEL} = 2 THEN 300000 WHEN {_LEVEL} = 3 THEN 500000 WHEN {_LEVEL} = 4 THEN 700000 ELSE 900000 END AS bzip2_block,
    CASE WHEN p_partkey % 2 = 0 THEN greatest(p_partkey * 5000, w) END AS block, p_partkey * 3000000 <= (greatest(least(greatest(w * 4, 1048576), 268435456), w) + 1048575) // 1048576 * 1048576 AS one_run
    FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 100 ELSE {_LISTS["d"]}[least({_LEVEL}, 9) + 1] END::BIGINT AS w FROM part)""")
def encoder_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a level and a size set an encoder to."""
    k = F.col("p_partkey")
    level, size = (k % 11).cast("int"), F.when(k % 3 != 0, k * 1000)
    wanted = sizes.effective_dictionary(level, F.when(k % 5 == 0, k * 100), F.lit(None).cast("long"))
    return adapters.table(spark, sf_dir, "part").select(
        "p_partkey", sizes.effective_dictionary(level, F.when(k % 5 == 0, k * 100), size).alias("dictionary"), sizes.nice_length(level).alias("nice_length"), sizes.chain_depth(level).alias("depth"),
        sizes.match_finder_threads(level, F.col("p_size") % 4).alias("threads"), sizes.bzip2_block(level).alias("bzip2_block"), sizes.block_size(F.when(k % 2 == 0, k * 5000), wanted).alias("block"),
        sizes.is_one_run(k * 3_000_000, wanted).alias("one_run"),
    )


for _name, _query in codec_queries.queries().items():
    QUERIES[_name] = _query


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
