"""Sizes, ratios, dictionaries and memory of coders. Column expressions only; null is unlimited or
unknown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KIB, MIB = 1 << 10, 1 << 20
LARGEST = (1 << 63) - 1

# Bytes that a decoder holds beside its window.
LZ_STATE = MIB
PPMD_STATE = MIB
BLOCK_INPUT = 64 * KIB
FIXED_MEMORY = {
    "COPY": 0,
    "BZIP2": 8 * MIB,
    "DEFLATE": MIB,
    "BROTLI": 32 * MIB,
    "ZSTD": 160 * MIB,
    "LZ4": 16 * MIB,
    "BCJ2": 16 * MIB,
    "AES256_SHA256": MIB,
    "DELTA": MIB,
    "BCJ_X86": MIB,
    "BCJ_ARM": MIB,
    "BCJ_ARM64": MIB,
    "BCJ_ARM_THUMB": MIB,
    "BCJ_PPC": MIB,
    "BCJ_IA64": MIB,
    "BCJ_SPARC": MIB,
    "BCJ_RISCV": MIB,
}

# Method ids by name.
METHOD_IDS = {
    "COPY": "00",
    "LZMA": "030101",
    "LZMA2": "21",
    "PPMD": "030401",
    "BZIP2": "040202",
    "ZSTD": "04F71101",
    "BROTLI": "04F71102",
    "LZ4": "04F71104",
    "LZS": "04F71105",
    "LIZARD": "04F71106",
    "DEFLATE": "040108",
    "DEFLATE64": "040109",
    "AES256_SHA256": "06F10701",
    "BCJ_X86": "03030103",
    "BCJ_PPC": "03030205",
    "BCJ_IA64": "03030401",
    "BCJ_ARM": "03030501",
    "BCJ_ARM64": "0A",
    "BCJ_ARM_THUMB": "03030701",
    "BCJ_SPARC": "03030805",
    "BCJ_RISCV": "0B",
    "DELTA": "03",
    "BCJ2": "0303011B",
}


def method_name(method_id: Column) -> Column:
    """The name of a method id (binary); null for one that isn't known."""
    pairs = [x for name, code in METHOD_IDS.items() for x in (F.lit(code), F.lit(name))]
    return F.try_element_at(F.create_map(*pairs), F.hex(method_id))


def end(offset: Column, size: Column) -> Column:
    """offset + size, at most the largest long."""
    return F.when(offset > F.lit(LARGEST) - size, F.lit(LARGEST)).otherwise(offset + size)


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def unpack_ratio_exceeds(unpacked: Column, packed: Column, limit: Column) -> Column:
    """Whether unpacked is over limit times packed; exact, and equality passes."""
    return F.coalesce((packed != 0) & (_wide(unpacked) > _wide(limit) * _wide(packed)), F.lit(False))


def unpack_ratio(unpacked: Column, packed: Column) -> Column:
    """unpacked over packed, rounded up; 0 without packed bytes."""
    return F.when(packed == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", _wide(unpacked) + _wide(packed) - 1, _wide(packed)).cast("long"))



def byte_at(data: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long")


def lzma_dictionary(properties: Column) -> Column:
    """The dictionary size that five property bytes of LZMA declare; null if they are malformed."""
    size = byte_at(properties, 1) + byte_at(properties, 2) * (1 << 8) + byte_at(properties, 3) * (1 << 16) + byte_at(properties, 4) * (1 << 24)
    return F.when((F.octet_length(properties) >= 5) & (byte_at(properties, 0) < 225), size)


def lzma2_dictionary_of(code: Column) -> Column:
    """The dictionary size for LZMA2's property byte, as a number; null above 40."""
    mantissa = F.lit(2).cast("long") + F.pmod(code, F.lit(2))
    return F.when(code == 40, F.lit((1 << 32) - 1)).when((code >= 0) & (code < 40), (mantissa * F.pow(F.lit(2), F.floor(code / 2) + 11)).cast("long"))


def lzma2_dictionary(properties: Column) -> Column:
    return F.when(F.octet_length(properties) >= 1, lzma2_dictionary_of(byte_at(properties, 0)))


def clamp_dictionary(dictionary: Column, unpacked: Column) -> Column:
    """No more dictionary than output, 4 KiB at least."""
    return F.least(dictionary, F.greatest(unpacked, F.lit(4 * KIB)))


def round_up(x: Column, unit: int) -> Column:
    return F.ceil(x / unit) * unit


def lzma_state(properties: Column) -> Column:
    """An LZMA decoder's probability table, never less than a MiB."""
    first = byte_at(properties, 0)
    bits = F.pmod(first, F.lit(9)) + F.pmod(F.floor(first / 9), F.lit(5))
    return F.greatest(F.lit(LZ_STATE), (F.lit(2) * (F.lit(1984) + F.lit(0x300) * F.pow(F.lit(2), bits)) + BLOCK_INPUT).cast("long"))


def coder_memory(method: Column, properties: Column) -> Column:
    """Bytes that a coder's decoder needs; null where no model sizes it."""
    out = F.when(method == "LZMA", round_up(lzma_dictionary(properties), 16) + lzma_state(properties))
    out = out.when(method == "LZMA2", round_up(lzma2_dictionary(properties), 16) + LZ_STATE)
    out = out.when(method == "PPMD", F.when(F.octet_length(properties) >= 5, byte_at(properties, 1) + byte_at(properties, 2) * (1 << 8) + byte_at(properties, 3) * (1 << 16) + byte_at(properties, 4) * (1 << 24) + PPMD_STATE))
    for name, size in FIXED_MEMORY.items():
        out = out.when(method == name, F.lit(size))
    return out.cast("long")


def encoder_run_cap(dictionary: Column) -> Column:
    """The longest run that an LZMA2 encoder with this dictionary writes."""
    four = F.least(F.greatest(dictionary * 4, F.lit(MIB)), F.lit(256 * MIB))
    return round_up(F.greatest(four, dictionary), MIB)


def is_stored_run(unpacked: Column, lzma_unpacked: Column) -> Column:
    """Whether a run is stored rather than compressed, but for a 64th of it."""
    return (unpacked > 0) & (lzma_unpacked * 64 <= unpacked)


def declared_folder_size(sizes: Column) -> Column:
    """The sum of the sizes of files that go into one folder; null if one is not known (0)."""
    return F.when(F.exists(sizes, lambda x: x == 0), F.lit(None).cast("long")).otherwise(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x))


def bzip2_block(level: Column) -> Column:
    """BZip2's block size for a level."""
    return F.when(level <= 1, 1).when(level == 2, 3).when(level == 3, 5).when(level == 4, 7).otherwise(9) * 100_000


def is_one_run(unpacked: Column, dictionary: Column) -> Column:
    """Whether an LZMA2 coder's output is no longer than one run of an encoder with its dictionary."""
    return F.coalesce(unpacked <= encoder_run_cap(dictionary), F.lit(False))


# By level from 0 on, an LZMA encoder's dictionary, nice match length and, for the
# levels with hash chains, their depth.
LEVEL_DICTIONARY = [1 << 18, 1 << 20, 1 << 21, 1 << 22, 1 << 22, 1 << 23, 1 << 23, 1 << 24, 1 << 25, 1 << 26]
LEVEL_NICE_LENGTH = [128, 128, 273, 273, 16, 32, 64, 64, 64, 64]
LEVEL_DEPTH = [4, 8, 24, 48]


def _by_level(values: list[int], level: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.least(level, F.lit(9)))


def effective_dictionary(level: Column, requested: Column, size: Column) -> Column:
    """The dictionary that an encoder uses: the one asked for or the level's, no more than the input
    where that is known, 4 KiB at least."""
    wanted = F.coalesce(requested, _by_level(LEVEL_DICTIONARY, level)).cast("long")
    return F.when(size.isNull(), wanted).otherwise(F.least(wanted, F.greatest(size, F.lit(4 * KIB))))


def nice_length(level: Column) -> Column:
    return _by_level(LEVEL_NICE_LENGTH, level)


def chain_depth(level: Column) -> Column:
    """Null for the levels without hash chains."""
    return F.when(level < len(LEVEL_DEPTH), F.get(F.array(*map(F.lit, LEVEL_DEPTH)), level))


def match_finder_threads(level: Column, threads: Column) -> Column:
    return F.when((level > 3) & (threads > 1), 2).otherwise(1)


def block_size(chunk: Column, dictionary: Column) -> Column:
    """An encoder's block: the chunk asked for, no less than its dictionary; null without a chunk."""
    return F.when(chunk.isNotNull(), F.greatest(chunk, dictionary))


def varint_length(x: Column) -> Column:
    """Bytes that the format's NUMBER takes for a value: one for each 7 bits, 9 at most."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(x < F.lit(1 << (7 * n)), F.lit(n)).otherwise(out)
    return out


def divide(a: Column, b: Column) -> Column:
    """a / b where both are positive, else null."""
    return F.when((a > 0) & (b > 0), a / b)


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))
