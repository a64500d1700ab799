"""The tables that an archive's header makes. Times are ticks of 100 ns since 1601; null is absent."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DecimalType, IntegerType, LongType, StringType, StructType

LONG, INT, TEXT, BYTES, FLAG, TICKS = LongType(), IntegerType(), StringType(), BinaryType(), BooleanType(), DecimalType(20, 0)


def table(**columns: DataType) -> StructType:
    out = StructType()
    for name, kind in columns.items():
        out.add(name, kind)
    return out


def without_archive(kind: StructType) -> StructType:
    return StructType([f for f in kind if f.name != "archive_id"])


CODER = table(method_id=BYTES, method=TEXT, num_in=LONG, num_out=LONG, properties=BYTES)
PAIR = table(in_index=LONG, out_index=LONG)

ARCHIVES = table(archive_id=TEXT, length=LONG, major=INT, minor=INT, next_header_offset=LONG, next_header_size=LONG, next_header_crc=LONG, pack_pos=LONG)
ENTRIES = table(
    archive_id=TEXT, file_index=LONG, name=TEXT, has_stream=FLAG, is_directory=FLAG, is_anti_item=FLAG,
    ctime_ticks=TICKS, atime_ticks=TICKS, mtime_ticks=TICKS, windows_attributes=LONG, size=LONG, crc=LONG,
)
BLOCKS = table(
    archive_id=TEXT, block_index=LONG, crc=LONG, num_sub_streams=LONG, num_packed=LONG, unpack_size=LONG, unpack_sizes=ArrayType(LONG),
    coders=ArrayType(CODER), bind_pairs=ArrayType(PAIR), packed_streams=ArrayType(LONG),
)
CODERS = table(archive_id=TEXT, block_index=LONG, coder_index=LONG, method_id=BYTES, method=TEXT, num_in=LONG, num_out=LONG, properties=BYTES)
PACK_STREAMS = table(archive_id=TEXT, pack_index=LONG, size=LONG, crc=LONG)
SUB_STREAMS = table(archive_id=TEXT, block_index=LONG, ordinal=LONG, size=LONG, crc=LONG)
CONTENTS = table(archive_id=TEXT, block_index=LONG, file_index=LONG, name=TEXT, offset=LONG, data=BYTES, crc32=LONG, error=TEXT)
TABLES = {"archives": ARCHIVES, "entries": ENTRIES, "blocks": BLOCKS, "coders": CODERS, "pack_streams": PACK_STREAMS, "sub_streams": SUB_STREAMS, "contents": CONTENTS}

ERROR = table(code=TEXT, message=TEXT, limit=TEXT, allowed=LONG, requested=LONG)
#: A whole header as one nested row.
PARSED = StructType([*ARCHIVES]).add("error", ERROR)
for _name in ("entries", "blocks", "pack_streams", "sub_streams"):
    PARSED = PARSED.add(_name, ArrayType(without_archive(TABLES[_name])))

MEMBER = table(name=TEXT, size=LONG, crc=LONG, ctime_ticks=TICKS, atime_ticks=TICKS, mtime_ticks=TICKS, windows_attributes=LONG, has_stream=FLAG, is_directory=FLAG)
#: An encoded block that no archive holds yet. pack_sizes cuts the packed bytes of a block with several
#: packed streams; null: there is one.
PREPARED = table(
    archive_id=TEXT, place=LONG, packed=BYTES, packed_crc=LONG, crc=LONG, unpack_size=LONG,
    coders=ArrayType(table(method=TEXT, properties=BYTES, size=LONG)), members=ArrayType(MEMBER), pack_sizes=ArrayType(LONG),
)
#: A prepared block in parts, each with the members that begin in it: part counts from 0, and the sizes
#: of the block and its coder are in each. Its packed bytes are those of the parts, in order.
PARTS = StructType([*PREPARED]).add("part", LONG)
