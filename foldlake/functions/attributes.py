"""Windows attributes and their Unix extension; time stamps in ticks of 100 ns since 1601."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the format.
DIRECTORY, REPARSE_POINT, UNIX_EXTENSION = 0x10, 0x400, 0x8000
UNIX_KIND, UNIX_SYMLINK = 0xF000, 0xA000
TICKS_A_SECOND = 10_000_000
EPOCH_SECONDS = 11_644_473_600
#: Ticks of 9999-12-31T23:59:59.9999999, the last that a timestamp holds.
LAST_TICKS = 2_650_467_743_999_999_999


def has(attributes: Column, bit: int) -> Column:
    return attributes.bitwiseAND(F.lit(bit).cast("long")) != 0


def unix_mode(attributes: Column) -> Column:
    """The Unix mode, where bit 15 says that there is one."""
    return F.when(has(attributes, UNIX_EXTENSION), F.shiftrightunsigned(attributes, 16).bitwiseAND(F.lit(0xFFFF).cast("long")))


def is_symlink(attributes: Column) -> Column:
    kind = F.coalesce(unix_mode(attributes).bitwiseAND(F.lit(UNIX_KIND).cast("long")), F.lit(0).cast("long"))
    return F.coalesce((kind == UNIX_SYMLINK) | has(attributes, REPARSE_POINT), F.lit(False))


def timestamp(ticks: Column) -> Column:
    """A timestamp of whole microseconds; null where none can hold it."""
    ticks = ticks.cast("decimal(20,0)")
    micros = F.floor(ticks / 10).cast("long") - EPOCH_SECONDS * 1_000_000
    return F.when((ticks >= 0) & (ticks <= LAST_TICKS), F.timestamp_micros(micros))


def ticks(at: Column) -> Column:
    return (F.unix_micros(at) + EPOCH_SECONDS * 1_000_000) * 10
