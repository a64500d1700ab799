"""CRC-32 of a whole from the CRCs of its parts."""

from __future__ import annotations

from functools import lru_cache

POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's, in its reflected bits."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = (b >> 1) ^ POLYNOMIAL if b & 1 else b >> 1
    return out


@lru_cache(maxsize=4096)
def _shift(length: int) -> int:
    """x to the power of 8 times length."""
    out, square = 1 << 31, 1 << 23  # 1, and x**8
    while length:
        if length & 1:
            out = _times(out, square)
        square = _times(square, square)
        length >>= 1
    return out


def combine(first: int, second: int, second_length: int) -> int:
    """The CRC of two strings in a row from theirs and the second's length."""
    return _times(_shift(second_length), first) ^ second if second_length else first
