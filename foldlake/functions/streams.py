"""Coders as streams: a block of any size goes through a chain in pieces of bounded size.

Each stage is an iterator of bytes over the one before it. What a stage holds is its coder's window
and one piece, so a task's memory doesn't grow with a solid block. The whole-value coders in
`codecs` give the same bytes; graphs with several inputs (BCJ2) use them.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa

from foldlake.functions import aes, codecs
from foldlake.functions.errors import ArchiveError, corrupted

STEP = 1 << 20


class Source:
    """An iterator of bytes that can be read like a file."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.closed = parts, b"", False

    def read(self, n: int = -1) -> bytes:
        out, size = [], 0
        while n < 0 or size < n:
            if not self.held:
                self.held = next(self.parts, b"")
                if not self.held:
                    break
            part = self.held if n < 0 else self.held[: n - size]
            self.held = self.held[len(part) :]
            out.append(part)
            size += len(part)
        return b"".join(out)

    def readable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False

    def close(self) -> None:
        self.closed = True


def _lzma(parts: Iterator[bytes], filters: list[dict]) -> Iterator[bytes]:
    try:
        coder = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters)
        for part in parts:
            out = coder.decompress(part, STEP)
            if out:
                yield out
            while not coder.eof and not coder.needs_input:
                if not (out := coder.decompress(b"", STEP)):
                    break
                yield out
            if coder.eof:
                return
        while not coder.eof and (out := coder.decompress(b"", STEP)):
            yield out
    except lzma.LZMAError as e:
        raise corrupted(f"LZMA data: {e}") from None
    except EOFError:
        return


def _bzip2(parts: Iterator[bytes]) -> Iterator[bytes]:
    coder = bz2.BZ2Decompressor()
    try:
        for part in parts:
            while part or not coder.needs_input:
                if coder.eof:
                    part = coder.unused_data + part if not part else part
                    coder = bz2.BZ2Decompressor()
                out = coder.decompress(part, STEP)
                part = coder.unused_data if coder.eof else b""
                if out:
                    yield out
                if coder.eof and not part:
                    break
    except (OSError, ValueError) as e:
        raise corrupted(f"BZip2 data: {e}") from None


def _deflate(parts: Iterator[bytes]) -> Iterator[bytes]:
    coder = zlib.decompressobj(-15)
    try:
        for part in parts:
            while part:
                yield coder.decompress(part, STEP)
                part = coder.unconsumed_tail
            if coder.eof:
                return
        yield coder.flush()
    except zlib.error as e:
        raise corrupted(f"Deflate data: {e}") from None


def _zstd(parts: Iterator[bytes]) -> Iterator[bytes]:
    import zstandard

    try:
        with zstandard.ZstdDecompressor(max_window_size=codecs.ZSTD_WINDOW).stream_reader(Source(parts), read_across_frames=True, closefd=False) as reader:
            while out := reader.read(STEP):
                yield out
    except zstandard.ZstdError as e:
        raise corrupted(f"Zstandard data: {e}") from None


def _framed(parts: Iterator[bytes], codec: str) -> Iterator[bytes]:
    source = Source(parts)
    head = source.read(4)
    if not head:
        return
    try:
        if struct.unpack("<I", head.ljust(4, b"\0"))[0] != codecs.SKIPPABLE:
            source.held = head + source.held
            with pa.CompressedInputStream(pa.PythonFile(source, "r"), codec) as reader:
                while out := reader.read(STEP):
                    yield out
            return
        rest = 12 if codec == "brotli" else 8
        while head:
            head += source.read(rest)
            if len(head) < 4 + rest:
                raise corrupted("a frame header is cut short")
            packed = source.read(struct.unpack_from("<I", head, 8)[0])
            yield codecs._streamed(head + packed, codec)
            head = source.read(4)
    except (OSError, pa.ArrowInvalid) as e:
        raise corrupted(f"{codec} data: {e}") from None


def _branch(parts: Iterator[bytes], method: str) -> Iterator[bytes]:
    def stored() -> Iterator[bytes]:
        first = True
        for part in parts:
            for i in range(0, len(part), 1 << 16):
                cut = part[i : i + (1 << 16)]
                yield struct.pack(">BH", 1 if first else 2, len(cut) - 1) + cut
                first = False
        yield b"\0"

    return _lzma(stored(), [{"id": codecs._BRANCH[method]}, codecs._STORE])


def _aligned(parts: Iterator[bytes], unit: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) in multiples of unit but for the last."""
    held, at = b"", 0
    for part in parts:
        held += part
        n = len(held) - len(held) % unit
        if n:
            yield at, held[:n]
            at, held = at + n, held[n:]
    if held:
        yield at, held


def _delta(parts: Iterator[bytes], distance: int) -> Iterator[bytes]:
    state = bytes(distance)
    for part in parts:
        out = codecs.delta(state + part, distance, False)
        state = out[-distance:]
        yield out[distance:]


def _aes(parts: Iterator[bytes], properties: bytes, password: str | None) -> Iterator[bytes]:
    if password is None:
        raise ArchiveError("PasswordRequired", "the archive is encrypted")
    power, salt, last = aes.properties(properties)
    key = aes.derive_key(password, power, salt)
    for _, part in _aligned(parts, 16):
        yield aes.cbc_decrypt(part, key, last)
        last = part[-16:]


def _exactly(parts: Iterator[bytes], size: int, method: str) -> Iterator[bytes]:
    done = 0
    if size:
        for part in parts:
            part = part[: size - done]
            done += len(part)
            if part:
                yield part
            if done == size:
                return
    if done < size:
        raise corrupted(f"{method} ends after {done} of {size} bytes")


def _riscv(parts: Iterator[bytes]) -> Iterator[bytes]:
    held, at = b"", 0
    for p in parts:
        out, done = codecs.riscv(held + p, False, at, False)
        held, at = (held + p)[done:], at + done
        yield out
    yield codecs.riscv(held, False, at)[0]


def decoded(method: str | None, properties: bytes, parts: Iterator[bytes], size: int, password: str | None = None) -> Iterator[bytes]:
    """One coder's output, exactly `size` bytes in all."""
    if method in codecs.DECODERS:
        out = iter([codecs.DECODERS[method](properties, b"".join(parts), size, password)])
    elif method == "COPY":
        out = parts
    elif method == "LZMA":
        out = _lzma(parts, [codecs._lzma_filter(properties, size)])
    elif method == "LZMA2":
        if not properties:
            raise corrupted("LZMA2 properties too short")
        dictionary = max(4096, min(codecs.lzma2_dictionary(properties[0]), max(size, 4096)))
        out = _lzma(parts, [{"id": lzma.FILTER_LZMA2, "dict_size": dictionary}])
    elif method == "BZIP2":
        out = _bzip2(parts)
    elif method == "DEFLATE":
        out = _deflate(parts)
    elif method == "ZSTD":
        out = _zstd(parts)
    elif method in ("LZ4", "BROTLI"):
        out = _framed(parts, method.lower())
    elif method in codecs._BRANCH:
        out = _branch(parts, method)
    elif method == "BCJ_ARM64":
        out = (codecs.arm64(p, False, at) for at, p in _aligned(parts, 4))
    elif method == "BCJ_RISCV":
        out = _riscv(parts)
    elif method == "DELTA":
        out = _delta(parts, (properties[0] if properties else 0) + 1)
    elif method == "AES256_SHA256":
        out = _aes(parts, properties, password)
    else:
        raise ArchiveError("UnsupportedMethod", method or "unknown method")
    return _exactly(out, size, method)
