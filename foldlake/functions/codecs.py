"""Coders: bytes to bytes, by method name, and chains of them.

The engines are the standard library's (LZMA, BZip2, Deflate), pyarrow's (LZ4, Brotli) and
zstandard's; filters are numpy or liblzma's. All are called on whole values in Arrow batches, never
inside a plan's expressions. Methods without an engine raise UnsupportedMethod.
"""

from __future__ import annotations

import bz2
import dataclasses
import lzma
import os
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from foldlake.functions import aes
from foldlake.functions.errors import ArchiveError, corrupted
from foldlake.functions.sizes import LEVEL_DEPTH, LEVEL_DICTIONARY, LEVEL_NICE_LENGTH, METHOD_IDS

NAMES = {bytes.fromhex(code): name for name, code in METHOD_IDS.items()}
IDS = {name: code for code, name in NAMES.items()}
SKIPPABLE = 0x184D2A50
ZSTD_WINDOW = 1 << 27

_BRANCH = {
    "BCJ_X86": lzma.FILTER_X86, "BCJ_PPC": lzma.FILTER_POWERPC, "BCJ_IA64": lzma.FILTER_IA64,
    "BCJ_ARM": lzma.FILTER_ARM, "BCJ_ARM_THUMB": lzma.FILTER_ARMTHUMB, "BCJ_SPARC": lzma.FILTER_SPARC,
}

@dataclasses.dataclass(frozen=True)
class Options:
    """What a coder is set to when it encodes; each uses what it knows."""

    level: int = 6
    dictionary: int | None = None
    lc: int = 3
    lp: int = 0
    pb: int = 2
    distance: int = 1
    power: int = 19
    salt: bytes = b""
    iv: bytes | None = None
    frame: int | None = None  # bytes of a skippable-framed piece for Brotli and LZ4
    chunk: int | None = None  # bytes after which LZMA2 begins a run of its own

    def dictionary_for(self, size: int | None) -> int:
        wanted = self.dictionary or LEVEL_DICTIONARY[max(0, min(9, self.level))]
        return max(4096, min(wanted, max(4096, size))) if size is not None else max(4096, wanted)


def lzma2_property(dictionary: int) -> int:
    """The smallest property byte whose dictionary is large enough."""
    return next((p for p in range(40) if (2 | p & 1) << (p // 2 + 11) >= dictionary), 40)


def lzma2_dictionary(prop: int) -> int:
    if prop > 40:
        raise corrupted("LZMA2 dictionary larger than the 4 GiB maximum")
    return (1 << 32) - 1 if prop == 40 else (2 | prop & 1) << (prop // 2 + 11)


def _lzma_filter(properties: bytes, size: int) -> dict:
    if len(properties) < 5:
        raise corrupted("LZMA properties too short")
    first = properties[0]
    if first >= 225:
        raise corrupted("invalid LZMA lc/lp/pb byte")
    dictionary = min(struct.unpack_from("<I", properties, 1)[0], max(size, 4096))
    return {"id": lzma.FILTER_LZMA1, "lc": first % 9, "lp": first // 9 % 5, "pb": first // 45, "dict_size": max(4096, dictionary)}


def _raw(data: bytes, filters: list[dict], size: int) -> bytes:
    try:
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data, size) if size else b""
    except lzma.LZMAError as e:
        raise corrupted(f"LZMA data: {e}") from None
    except (ValueError, OverflowError, MemoryError) as e:
        raise ArchiveError("UnsupportedMethod", f"LZMA filter: {e}") from None


def _stored(data: bytes) -> bytes:
    """LZMA2 that stores data: what liblzma's branch filters can stand on."""
    out = []
    for i in range(0, len(data), 1 << 16):
        part = data[i : i + (1 << 16)]
        out.append(struct.pack(">BH", 2 if i else 1, len(part) - 1) + part)
    return b"".join([*out, b"\0"])


_STORE = {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}


def branch_decode(method: str, data: bytes) -> bytes:
    return _raw(_stored(data), [{"id": _BRANCH[method]}, _STORE], len(data))


def branch_encode(method: str, data: bytes) -> bytes:
    coder = lzma.LZMACompressor(lzma.FORMAT_RAW, filters=[{"id": _BRANCH[method]}, {**_STORE, "preset": 0}])
    return _raw(coder.compress(data) + coder.flush(), [{**_STORE, "dict_size": 1 << 20}], len(data))


def arm64(data: bytes, encode: bool, place: int = 0) -> bytes:
    """Branches with link and page addresses of ARM64, relative to absolute and back. Each word
    stands for itself, so all are changed at once. place: where data begins in the whole."""
    n = len(data) // 4
    words = np.frombuffer(data, "<u4", n).astype(np.uint32)
    at = (np.arange(n, dtype=np.uint64) + np.uint64(place // 4)).astype(np.uint32)
    sign = np.uint32(1 if encode else 0xFFFFFFFF)
    link = words & np.uint32(0xFC000000) == np.uint32(0x94000000)
    with np.errstate(over="ignore"):
        moved = np.uint32(0x94000000) | (words + at * sign) & np.uint32(0x03FFFFFF)
        page = words & np.uint32(0x9F000000) == np.uint32(0x90000000)
        source = words >> np.uint32(29) & np.uint32(3) | words >> np.uint32(3) & np.uint32(0x001FFFFC)
        page &= (source + np.uint32(0x00020000)) & np.uint32(0x001C0000) == 0
        target = source + (at >> np.uint32(10)) * sign
        shifted = words & np.uint32(0x9000001F) | (target & np.uint32(3)) << np.uint32(29) | (target & np.uint32(0x0003FFFC)) << np.uint32(3) | (np.uint32(0) - (target & np.uint32(0x00020000))) & np.uint32(0x00E00000)
    words = np.where(link, moved, np.where(page, shifted, words))
    return words.astype("<u4").tobytes() + data[4 * n :]


def riscv(data: bytes, encode: bool, place: int = 0, last: bool = True) -> tuple[bytes, int]:
    """Jumps and address pairs of RISC-V, relative to absolute and back: the bytes that are settled,
    changed, and how many they are. An instruction is looked at with the eight bytes from it on, so
    the last seven wait for more unless this is the end. place: where data begins in the whole."""
    out, n = bytearray(data), len(data)
    values = np.frombuffer(data, np.uint8)[: max(0, n - 7) : 2]
    found = np.flatnonzero((values == 0xEF) | (values & 0x7F == 0x17)) * 2
    free = 0  # where the next instruction may begin
    for i in found.tolist():
        if i < free:
            continue
        here = place + i
        word = int.from_bytes(out[i : i + 4], "little")
        if word & 0xFF == 0xEF:
            if word & 0x0D00:  # the link goes to a register that calls don't use
                continue
            if encode:
                target = (word >> 20 & 0x7FE) | (word >> 9 & 0x800) | (word & 0xFF000) | (word >> 11 & 0x100000)
                target += here
                out[i + 1] = out[i + 1] & 0x0F | target >> 13 & 0xF0
                out[i + 2], out[i + 3] = target >> 9 & 0xFF, target >> 1 & 0xFF
            else:
                target = (out[i + 1] & 0xF0) << 13 | out[i + 2] << 9 | out[i + 3] << 1
                target = (target - here) & 0xFFFFFFFF
                word = word & 0xFFF | target & 0xFF000 | (target & 0x800) << 9 | (target & 0x7FE) << 20 | (target & 0x100000) << 11
                out[i : i + 4] = word.to_bytes(4, "little")
            free = i + 4
            continue
        after = int.from_bytes(out[i + 4 : i + 8], "little")
        if word & 0xE80:  # a page address in a register of its own, and what adds to it
            if (word << 8 ^ (after - 3)) & 0xF8003:
                free = i + 6
                continue
            if encode:
                target = ((word & 0xFFFFF000) + (after >> 20) - (after >> 19 & 0x1000) + here) & 0xFFFFFFFF
                pair = (0x117 | after << 12) & 0xFFFFFFFF, int.from_bytes(target.to_bytes(4, "big"), "little")
            else:
                pair = (0x117 | after << 12) & 0xFFFFFFFF, (word & 0xFFFFF000) + (after >> 20) & 0xFFFFFFFF
        else:  # what an encoder makes of a pair, or stands in for what looks like that
            register = word >> 27
            if (word - 0x3117 << 18 & 0xFFFFFFFF) >= register & 0x1D:
                free = i + 4
                continue
            if encode:
                pair = (0x17 | register << 7 | after & 0xFFFFF000) & 0xFFFFFFFF, (word >> 12 | after << 20) & 0xFFFFFFFF
            else:
                target = (int.from_bytes(out[i + 4 : i + 8], "big") - here) & 0xFFFFFFFF
                pair = 0x17 | register << 7 | target + 0x800 & 0xFFFFF000, (word >> 12 | target << 20) & 0xFFFFFFFF
        out[i : i + 4], out[i + 4 : i + 8] = (p.to_bytes(4, "little") for p in pair)
        free = i + 8
    done = n if last else max(free, (n - 7 + 1) // 2 * 2 if n > 7 else 0)
    return bytes(out[:done]), done


def delta(data: bytes, distance: int, encode: bool) -> bytes:
    values = np.frombuffer(data, np.uint8)
    if encode:
        out = values.copy()
        out[distance:] -= values[:-distance] if distance < len(values) else values[:0]
        return out.tobytes()
    padded = np.concatenate([values, np.zeros(-len(values) % distance, np.uint8)]).reshape(-1, distance)
    return np.cumsum(padded, axis=0, dtype=np.uint8).tobytes()[: len(data)]


def _frames(data: bytes, what: str) -> list[bytes] | None:
    """The pieces behind skippable headers that give their sizes; None if there are no headers."""
    if len(data) < 4 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return None
    out, at = [], 0
    while at < len(data):
        if len(data) - at < 8:
            raise corrupted("a frame header is cut short")
        magic, size = struct.unpack_from("<II", data, at)
        if magic != SKIPPABLE or size != (8 if what == "brotli" else 4) or len(data) - at < 8 + size:
            raise corrupted("a frame header is malformed")
        packed = struct.unpack_from("<I", data, at + 8)[0]
        if what == "brotli" and data[at + 12 : at + 14] != b"BR":
            raise corrupted("a frame is not Brotli's")
        at += 8 + size
        if at + packed > len(data):
            raise corrupted("a frame is cut short")
        out.append(data[at : at + packed])
        at += packed
    return out


def _streamed(data: bytes, codec: str) -> bytes:
    pieces = _frames(data, codec)
    try:
        return b"".join(pa.CompressedInputStream(pa.BufferReader(p), codec).read() for p in ([data] if pieces is None else pieces) if p)
    except (OSError, pa.ArrowInvalid) as e:
        raise corrupted(f"{codec} data: {e}") from None


def _framed(data: bytes, codec: str, frame: int | None, level: int | None) -> bytes:
    coder = pa.Codec(codec, level) if level is not None else pa.Codec(codec)
    if frame is None:
        return coder.compress(data, asbytes=True)
    out = []
    for i in range(0, max(1, len(data)), frame):
        part = data[i : i + frame]
        packed = coder.compress(part, asbytes=True)
        if codec == "brotli":
            out.append(struct.pack("<III2sH", SKIPPABLE, 8, len(packed), b"BR", min(0xFFFF, -(-len(part) >> 16))))
        else:
            out.append(struct.pack("<III", SKIPPABLE, 4, len(packed)))
        out.append(packed)
    return b"".join(out)


#: Coders that a host brings along or puts in the place of these, by method name.
DECODERS: dict[str, Callable[[bytes, bytes, int, str | None], bytes]] = {}
ENCODERS: dict[str, Callable[[bytes, Options, str | None], tuple[bytes, bytes]]] = {}


def register(method: str, decode: Callable[[bytes, bytes, int, str | None], bytes] | None = None, encode: Callable[[bytes, Options, str | None], tuple[bytes, bytes]] | None = None, method_id: bytes | None = None) -> None:
    """A coder of the host's in this process: decode(properties, data, size, password) gives the
    bytes, encode(data, options, password) the properties and the packed bytes. None takes it back.
    Workers are other processes: what they shall have, the `setup` of a walk or of contents registers."""
    for table, coder in ((DECODERS, decode), (ENCODERS, encode)):
        table.pop(method, None)
        if coder is not None:
            table[method] = coder
    if method_id is not None:
        NAMES[method_id], IDS[method] = method, method_id


def decode(method: str | None, properties: bytes, data: bytes, size: int, password: str | None = None) -> bytes:
    """One coder's output, exactly `size` bytes."""
    if method in DECODERS:
        out = DECODERS[method](properties, data, size, password)
    elif method == "COPY":
        out = data
    elif method == "LZMA":
        out = _raw(data, [_lzma_filter(properties, size)], size)
    elif method == "LZMA2":
        if not properties:
            raise corrupted("LZMA2 properties too short")
        out = _raw(data, [{"id": lzma.FILTER_LZMA2, "dict_size": max(4096, min(lzma2_dictionary(properties[0]), max(size, 4096), (1 << 32) - 1))}], size)
    elif method == "BZIP2":
        try:
            out = bz2.decompress(data) if data else b""
        except (OSError, ValueError) as e:
            raise corrupted(f"BZip2 data: {e}") from None
    elif method == "DEFLATE":
        try:
            out = zlib.decompressobj(-15).decompress(data, size) if size else b""
        except zlib.error as e:
            raise corrupted(f"Deflate data: {e}") from None
    elif method == "ZSTD":
        import zstandard

        try:
            out = zstandard.ZstdDecompressor(max_window_size=ZSTD_WINDOW).stream_reader(data, read_across_frames=True).read() if data else b""
        except zstandard.ZstdError as e:
            raise corrupted(f"Zstandard data: {e}") from None
    elif method == "LZ4":
        out = _streamed(data, "lz4") if data else b""
    elif method == "BROTLI":
        out = _streamed(data, "brotli") if data else b""
    elif method in _BRANCH:
        out = branch_decode(method, data)
    elif method == "BCJ_ARM64":
        out = arm64(data, False)
    elif method == "BCJ_RISCV":
        out = riscv(data, False)[0]
    elif method == "DELTA":
        out = delta(data, (properties[0] if properties else 0) + 1, False)
    elif method == "AES256_SHA256":
        if password is None:
            raise ArchiveError("PasswordRequired", "the archive is encrypted")
        power, salt, iv = aes.properties(properties)
        out = aes.cbc_decrypt(data, aes.derive_key(password, power, salt), iv)[:size]
    else:
        raise ArchiveError("UnsupportedMethod", method or "unknown method")
    if len(out) < size:
        raise corrupted(f"{method} ends after {len(out)} of {size} bytes")
    return out[:size] if len(out) > size else out


def _compressed(data: bytes, spec: dict) -> bytes:
    coder = lzma.LZMACompressor(lzma.FORMAT_RAW, filters=[spec])
    return coder.compress(data) + coder.flush()


def _lzma_spec(method: str, options: Options, dictionary: int) -> dict:
    level = max(0, min(9, options.level))
    spec = {
        "id": lzma.FILTER_LZMA1 if method == "LZMA" else lzma.FILTER_LZMA2, "preset": level, "dict_size": dictionary, "lc": options.lc, "lp": options.lp, "pb": options.pb,
        "nice_len": LEVEL_NICE_LENGTH[level],
    }
    if level < len(LEVEL_DEPTH):
        spec |= {"mode": lzma.MODE_FAST, "mf": lzma.MF_HC4, "depth": LEVEL_DEPTH[level]}
    return spec


def lzma2_run(data: bytes, options: Options, dictionary: int) -> bytes:
    """A run of LZMA2 chunks, without an end mark: each block ends with one, which only the last keeps."""
    return _compressed(data, _lzma_spec("LZMA2", options, dictionary))[:-1]


def encode(method: str, data: bytes, options: Options = Options(), password: str | None = None) -> tuple[bytes, bytes]:  # noqa: B008
    """(properties, packed)."""
    if method in ENCODERS:
        return ENCODERS[method](data, options, password)
    level = max(0, min(9, options.level))
    if method == "COPY":
        return b"", data
    if method in ("LZMA", "LZMA2"):
        dictionary = options.dictionary_for(len(data))
        if method == "LZMA":
            return struct.pack("<BI", (options.pb * 5 + options.lp) * 9 + options.lc, dictionary), _compressed(data, _lzma_spec(method, options, dictionary))
        step = max(options.chunk, dictionary) if options.chunk else max(1, len(data))
        runs = [lzma2_run(data[i : i + step], options, dictionary) for i in range(0, len(data), step)]
        return bytes([lzma2_property(dictionary)]), b"".join(runs) + b"\0"
    if method == "BZIP2":
        return b"", bz2.compress(data, {0: 1, 1: 1, 2: 3, 3: 5, 4: 7}.get(level, 9))
    if method == "DEFLATE":
        coder = zlib.compressobj(level, zlib.DEFLATED, -15)
        return b"", coder.compress(data) + coder.flush()
    if method == "ZSTD":
        import zstandard

        return b"\1\5" + bytes([options.level, 0, 0]), zstandard.ZstdCompressor(level=options.level).compress(data)
    if method == "LZ4":
        return b"\1\x09" + bytes([level, 0, 0]), _framed(data, "lz4", options.frame, None)
    if method == "BROTLI":
        return b"\1\0" + bytes([level]), _framed(data, "brotli", options.frame, level)
    if method in _BRANCH:
        return b"", branch_encode(method, data)
    if method == "BCJ_ARM64":
        return b"", arm64(data, True)
    if method == "BCJ_RISCV":
        return b"", riscv(data, True)[0]
    if method == "DELTA":
        if not 1 <= options.distance <= 256:
            raise ArchiveError("InvalidArgument", "a delta distance is 1 to 256")
        return bytes([options.distance - 1]), delta(data, options.distance, True)
    if method == "AES256_SHA256":
        if password is None:
            raise ArchiveError("PasswordRequired", "encryption needs a password")
        iv = options.iv if options.iv is not None else os.urandom(16)
        return aes.make_properties(options.power, options.salt, iv), aes.cbc_encrypt(data, aes.derive_key(password, options.power, options.salt), iv)
    raise ArchiveError("UnsupportedMethod", f"{method} is not written")


def encode_chain(methods: list[tuple[str, Options]], data: bytes, password: str | None = None) -> tuple[list[tuple[str, bytes, int]], bytes]:
    """Coders from the output to the packed stream, as a header lists them: (method, properties,
    unpacked size); and the packed bytes. methods: the first touches the plain bytes first."""
    coders = []
    for method, options in methods:
        size = len(data)
        properties, data = encode(method, data, options, password)
        coders.append((method, properties, size))
    return coders, data


def encode_bcj2(methods: list[tuple[str, Options]], data: bytes, password: str | None = None) -> tuple[list[tuple[str, bytes, int]], list[bytes]]:
    """x86 code as four streams: the coders BCJ2, that of the main stream (the second method) and two
    LZMA coders for targets, and the packed streams main, call, jump and range coder."""
    from foldlake.functions import bcj2

    (_, _), (method, options) = methods
    main, call, jump, coded = bcj2.encode(data)
    coders, packed = [("BCJ2", b"", len(data))], []
    for name, how, stream in ((method, options, main), ("LZMA", Options(level=options.level), call), ("LZMA", Options(level=options.level), jump)):
        properties, out = encode(name, stream, how, password)
        coders.append((name, properties, len(stream)))
        packed.append(out)
    return coders, [*packed, coded]
