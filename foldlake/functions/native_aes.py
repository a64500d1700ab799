"""AES-256-CBC without padding on Spark's own functions.

Spark decrypts CBC with PKCS padding alone. A block of padding can be made for any ciphertext: the
encryption of sixteen 0x10 bytes with the last block as initial vector. With it appended, the bytes
are valid padded input, and what comes back is the plain text. Keys given as columns show in plans,
so the session must redact them (spark.sql.redaction.string.regex), or functions.aes be used.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _mode() -> tuple[Column, Column]:
    return F.lit("CBC"), F.lit("PKCS")


def decrypt(data: Column, key: Column, iv: Column, size: Column | None = None) -> Column:
    """The plain bytes of whole blocks, cut to size."""
    mode, padding = _mode()
    last = F.substring(data, F.octet_length(data) - 15, F.lit(16))
    # the cipher text of an empty value is its vector and one block of padding
    block = F.substring(F.aes_encrypt(F.lit(b""), key, mode, padding, last), 17, 16)
    plain = F.aes_decrypt(F.concat(iv, data, block), key, mode, padding)
    plain = F.when(F.octet_length(data) == 0, F.lit(b"")).otherwise(plain)
    return plain if size is None else F.substring(plain, F.lit(1), size)


def encrypt(data: Column, key: Column, iv: Column) -> Column:
    """data filled up with zeros to whole blocks, encrypted, without the vector."""
    mode, padding = _mode()
    fill = F.pmod(-F.octet_length(data), F.lit(16))
    whole = F.concat(data, F.substring(F.lit(bytes(16)), F.lit(1), fill))
    packed = F.aes_encrypt(whole, key, mode, padding, iv)
    return F.substring(packed, F.lit(17), F.octet_length(whole))
