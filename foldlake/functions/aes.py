"""AES-256 in CBC mode without padding, and the key derivation of encrypted archives.

The OpenSSL that the interpreter's hashlib is linked with does both. Without it, decryption of all
blocks of a value is one numpy pass per round, since a block of CBC needs only the ciphertext before
it, and encryption goes block after block. Keys are cached for each process by (power, salt, password
digest); passwords stay out of DataFrames, plans and logs: callers hand them over in a closure.
"""

from __future__ import annotations

import ctypes
import hashlib
from functools import lru_cache

import numpy as np

from foldlake.functions.errors import ArchiveError

NO_DERIVATION = 63
MAX_POWER = 24


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The substitution box and its inverse, from inverses in GF(2**8) and the affine map."""
    exp, x = [], 1
    for _ in range(255):
        exp.append(x)
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    log = {v: i for i, v in enumerate(exp)}
    box = np.zeros(256, np.uint8)
    for v in range(256):
        inverse = exp[(255 - log[v]) % 255] if v else 0
        out = 0x63
        for k in range(5):
            out ^= ((inverse << k) | (inverse >> (8 - k))) & 0xFF
        box[v] = out
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256, dtype=np.uint8)
    return box, back


BOX, BACK = _tables()


def _times(c: int) -> np.ndarray:
    """Products of all bytes with c in GF(2**8)."""
    out = np.zeros(256, np.uint8)
    for v in range(256):
        a, b, p = v, c, 0
        while b:
            p ^= a * (b & 1)
            a = (a << 1) ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        out[v] = p & 0xFF
    return out


T2, T3, T9, T11, T13, T14 = map(_times, (2, 3, 9, 11, 13, 14))
_ROW_SHIFT = np.array([0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11])
_ROW_BACK = np.argsort(_ROW_SHIFT)


@lru_cache(maxsize=16)
def _round_keys(key: bytes) -> np.ndarray:
    words = [list(key[4 * i : 4 * i + 4]) for i in range(8)]
    rcon = 1
    for i in range(8, 60):
        w = list(words[-1])
        if i % 8 == 0:
            w = [int(BOX[b]) for b in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = (rcon << 1) ^ (0x11B if rcon & 0x80 else 0)
        elif i % 8 == 4:
            w = [int(BOX[b]) for b in w]
        words.append([a ^ b for a, b in zip(w, words[i - 8], strict=True)])
    return np.array(words, np.uint8).reshape(15, 16)


#: Bytes for one call of OpenSSL, which counts them as a C int.
STEP = 1 << 28


@lru_cache(maxsize=1)
def _openssl() -> ctypes.CDLL | None:
    """The library behind hashlib; None where the interpreter has none, or none with these functions."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.EVP_aes_256_cbc.restype = lib.EVP_CIPHER_CTX_new.restype = ctypes.c_void_p
        lib.EVP_aes_256_cbc.argtypes = lib.EVP_CIPHER_CTX_new.argtypes = []
        lib.EVP_CIPHER_CTX_free.restype, lib.EVP_CIPHER_CTX_free.argtypes = None, [ctypes.c_void_p]
        lib.EVP_CIPHER_CTX_set_padding.argtypes = [ctypes.c_void_p, ctypes.c_int]
        lib.EVP_CipherInit_ex.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_void_p, ctypes.c_char_p, ctypes.c_char_p, ctypes.c_int]
        lib.EVP_CipherUpdate.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.POINTER(ctypes.c_int), ctypes.c_char_p, ctypes.c_int]
    except (ImportError, AttributeError, OSError, TypeError):
        return None
    return lib


def _native(data: bytes, key: bytes, iv: bytes, encrypt: bool) -> bytes | None:
    """Whole blocks through OpenSSL; None where it can't be had."""
    lib = _openssl()
    context = lib and lib.EVP_CIPHER_CTX_new()
    if not context:
        return None
    try:
        if lib.EVP_CipherInit_ex(context, lib.EVP_aes_256_cbc(), None, key, iv, encrypt) != 1:
            return None
        lib.EVP_CIPHER_CTX_set_padding(context, 0)
        out, n = [], ctypes.c_int()
        for i in range(0, len(data), STEP):
            part = data[i : i + STEP]
            # without padding a call that gets whole blocks gives as many bytes as it gets
            buffer = ctypes.create_string_buffer(len(part) + 16)
            if lib.EVP_CipherUpdate(context, buffer, ctypes.byref(n), part, len(part)) != 1 or n.value != len(part):
                return None
            out.append(ctypes.string_at(buffer, n.value))
        return b"".join(out)
    finally:
        lib.EVP_CIPHER_CTX_free(context)


def _encrypt_block(state: np.ndarray, keys: np.ndarray) -> np.ndarray:
    state = state ^ keys[0]
    for r in range(1, 15):
        state = BOX[state][_ROW_SHIFT]
        if r < 14:
            c = state.reshape(4, 4)
            n = np.roll(c, -1, axis=1)
            state = (T2[c] ^ T3[n] ^ np.roll(c, -2, axis=1) ^ np.roll(c, -3, axis=1)).reshape(16)
        state = state ^ keys[r]
    return state


def cbc_encrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    """data is filled up with zeros to whole blocks."""
    data, iv = data + bytes(-len(data) % 16), iv.ljust(16, b"\0")[:16]
    native = _native(data, key, iv, True)
    return _plain_encrypt(data, key, iv) if native is None else native


def _plain_encrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    keys, last, out = _round_keys(key), np.frombuffer(iv, np.uint8), np.empty_like(blocks)
    for i, block in enumerate(blocks):
        last = out[i] = _encrypt_block(block ^ last, keys)
    return out.tobytes()


def cbc_decrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    if len(data) % 16:
        raise ArchiveError("Corrupted", "encrypted bytes are not whole blocks")
    iv = iv.ljust(16, b"\0")[:16]
    native = _native(data, key, iv, False)
    return _plain_decrypt(data, key, iv) if native is None else native


def _plain_decrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    keys = _round_keys(key)
    state = blocks ^ keys[14]
    for r in range(13, -1, -1):
        state = BACK[state[:, _ROW_BACK]] ^ keys[r]
        if r:
            c = state.reshape(-1, 4, 4)
            state = (T14[c] ^ T11[np.roll(c, -1, axis=2)] ^ T13[np.roll(c, -2, axis=2)] ^ T9[np.roll(c, -3, axis=2)]).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(iv, np.uint8)[None], blocks[:-1]]) if len(blocks) else blocks
    return (state ^ before).tobytes()


def properties(data: bytes) -> tuple[int, bytes, bytes]:
    """power, salt, iv out of a coder's properties."""
    if not data:
        raise ArchiveError("Corrupted", "AES256 properties too short")
    first = data[0]
    power = first & 63
    if not first & 0xC0:
        return power, b"", bytes(16)
    if len(data) < 2:
        raise ArchiveError("Corrupted", "AES256 properties too short")
    salt_size = (first >> 7 & 1) + (data[1] >> 4)
    iv_size = (first >> 6 & 1) + (data[1] & 15)
    if len(data) < 2 + salt_size + iv_size:
        raise ArchiveError("Corrupted", "AES256 properties too short")
    return power, data[2 : 2 + salt_size], data[2 + salt_size : 2 + salt_size + iv_size].ljust(16, b"\0")


def make_properties(power: int, salt: bytes, iv: bytes) -> bytes:
    first = power | (0x80 if salt else 0) | (0x40 if iv else 0)
    if not first & 0xC0:
        return bytes([first])
    return bytes([first, (max(0, len(salt) - 1) << 4) | max(0, len(iv) - 1)]) + salt + iv


@lru_cache(maxsize=4)
def derive_key(password: str, power: int, salt: bytes) -> bytes:
    """SHA-256 over 2**power rounds of salt, password (UTF-16LE) and a counter; at 63 the salt and
    password themselves."""
    secret = salt + password.encode("utf-16-le")
    if power == NO_DERIVATION:
        return secret.ljust(32, b"\0")[:32]
    if power > MAX_POWER:
        raise ArchiveError("LimitExceeded", f"AES work factor {power} is over {MAX_POWER}")
    digest, rounds, step = hashlib.sha256(), 1 << power, 1 << min(power, 12)
    for i in range(0, rounds, step):
        digest.update(b"".join([secret + n.to_bytes(8, "little") for n in range(i, i + step)]))
    return digest.digest()
