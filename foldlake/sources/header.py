"""Reads and writes the header of a 7z archive: sections of bytes to rows and back.

Parsing is the one loop over bytes in this package. It yields plain rows for the tables in
`foldlake.schemas` and checks what a header itself can violate; whatever follows from the rows
(offsets, lineage, sizes left over) is derived in operators.catalog.
"""

from __future__ import annotations

import dataclasses
import struct
import zlib
from collections.abc import Callable

from foldlake.functions import codecs
from foldlake.functions.errors import ArchiveError, corrupted, exceeded
from foldlake.operators.limits import ArchiveLimits

# Fixed values of the format.
SIGNATURE = b"7z\xbc\xaf\x27\x1c"
HEADER_SIZE = 32
END, HEADER, ARCHIVE_PROPERTIES, ADDITIONAL, MAIN, FILES, PACK_INFO, UNPACK_INFO, SUB_STREAMS = range(9)
SIZE, CRC, FOLDER, UNPACK_SIZE, NUM_UNPACK = range(0x09, 0x0E)
EMPTY_STREAM, EMPTY_FILE, ANTI, NAMES, CTIME, ATIME, MTIME, ATTRIBUTES, COMMENT, ENCODED, START_POS, DUMMY = range(0x0E, 0x1A)
HARD_CODERS = 64
RECOVERY_BYTES = 1 << 20


class Reader:
    """Bytes with a place; every read is checked against what is left."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n > self.left:
            raise corrupted("the header ends too soon")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """One to nine bytes: the leading ones of the first say how many follow."""
        first, value = self.byte(), 0
        for i in range(8):
            mask = 0x80 >> i
            if not first & mask:
                return value | (first & (mask - 1)) << (8 * i)
            value |= self.byte() << (8 * i)
        return value

    def count(self, limit: str, bound: int | None, each: int = 1) -> int:
        """A number of things of `each` bytes at least: what is there bounds it before any limit does."""
        n = self.number()
        if each and n > self.left // each:
            raise corrupted(f"{n} {limit} can't fit {self.left} bytes")
        if bound is not None and n > bound:
            raise exceeded(limit, bound, n)
        return n

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def bits(self, n: int) -> list[bool]:
        data = self.take((n + 7) // 8)
        return [bool(data[i >> 3] & 0x80 >> (i & 7)) for i in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def crcs(self, n: int) -> list[int | None]:
        there = self.defined(n)
        return [self.u32() if d else None for d in there]

    def expect(self, tag: int) -> None:
        if (got := self.byte()) != tag:
            raise corrupted(f"section {tag:#x} was expected, not {got:#x}")


@dataclasses.dataclass
class Streams:
    pack_pos: int = 0
    pack_sizes: list[int] = dataclasses.field(default_factory=list)
    pack_crcs: list[int | None] = dataclasses.field(default_factory=list)
    folders: list[dict] = dataclasses.field(default_factory=list)
    sub_streams: list[dict] = dataclasses.field(default_factory=list)


def _pack_info(r: Reader, limits: ArchiveLimits, out: Streams) -> None:
    out.pack_pos = r.number()
    n = r.count("PackStreams", limits.max_pack_streams)
    tag = r.byte()
    if tag == SIZE:
        out.pack_sizes = [r.number() for _ in range(n)]
        tag = r.byte()
    elif n:
        raise corrupted("pack streams have no sizes")
    out.pack_crcs = [None] * n
    if tag == CRC:
        out.pack_crcs = r.crcs(n)
        tag = r.byte()
    if tag != END:
        raise corrupted("pack info doesn't end")


def _folder(r: Reader, limits: ArchiveLimits) -> dict:
    n = r.count("CodersPerBlock", limits.max_coders_per_block, 2)
    if n > HARD_CODERS:
        raise exceeded("CodersPerBlock", HARD_CODERS, n)
    if not n:
        raise corrupted("a block has no coders")
    coders, inputs, outputs = [], 0, 0
    for _ in range(n):
        flags = r.byte()
        if flags & 0xC0:
            raise ArchiveError("UnsupportedMethod", "alternative coder methods")
        method = r.take(flags & 15)
        num_in, num_out = (r.number(), r.number()) if flags & 0x10 else (1, 1)
        for k in (num_in, num_out):
            if limits.max_streams_per_coder is not None and k > limits.max_streams_per_coder:
                raise exceeded("StreamsPerCoder", limits.max_streams_per_coder, k)
        if num_out != 1:
            raise corrupted("a coder has not exactly one output")
        properties = r.take(r.count("PropertyBytes", limits.max_header_bytes)) if flags & 0x20 else b""
        coders.append({"method_id": method, "num_in": num_in, "num_out": num_out, "properties": properties})
        inputs, outputs = inputs + num_in, outputs + num_out
    if inputs > HARD_CODERS:
        raise exceeded("StreamsPerCoder", HARD_CODERS, inputs)
    pairs = [{"in_index": r.number(), "out_index": r.number()} for _ in range(outputs - 1)]
    if any(p["in_index"] >= inputs or p["out_index"] >= outputs for p in pairs):
        raise corrupted("a bind pair names a stream that isn't there")
    if inputs < len(pairs):
        raise corrupted("more bind pairs than inputs")
    packed = inputs - len(pairs)
    bound = {p["in_index"] for p in pairs}
    free = [i for i in range(inputs) if i not in bound]
    if packed == 1:
        if not free:
            raise corrupted("no input is left for the packed stream")
        packed_streams = free[:1]
    else:
        packed_streams = [r.number() for _ in range(packed)]
    folder = {"coders": coders, "bind_pairs": pairs, "packed_streams": packed_streams, "crc": None, "num_sub_streams": 1}
    validate_graph(folder)
    return folder


def validate_graph(folder: dict) -> int:
    """The coder whose output is the block's. Each input is fed once, one output is free, and no way
    from it comes back."""
    coders, pairs = folder["coders"], folder["bind_pairs"]
    inputs = sum(c["num_in"] for c in coders)
    fed = [p["in_index"] for p in pairs] + folder["packed_streams"]
    if sorted(fed) != list(range(inputs)):
        raise corrupted("an input is bound or packed more or less than once")
    free = set(range(len(coders))) - {p["out_index"] for p in pairs}
    if len(free) != 1 or len({p["out_index"] for p in pairs}) != len(pairs):
        raise corrupted("not exactly one free output")
    first, at = [], 0
    for c in coders:
        first.append(at)
        at += c["num_in"]
    source = {p["in_index"]: p["out_index"] for p in pairs}
    root = free.pop()

    def visit(coder: int, path: frozenset[int]) -> None:
        if coder in path:
            raise corrupted("coders form a cycle")
        for i in range(first[coder], first[coder] + coders[coder]["num_in"]):
            if i in source:
                visit(source[i], path | {coder})

    visit(root, frozenset())
    return root


def _unpack_info(r: Reader, limits: ArchiveLimits, out: Streams) -> None:
    r.expect(FOLDER)
    n = r.count("Blocks", limits.max_blocks)
    if r.byte():
        raise ArchiveError("UnsupportedMethod", "folders in an additional stream")
    total = 0
    for _ in range(n):
        folder = _folder(r, limits)
        total += len(folder["coders"])
        if limits.max_total_coders is not None and total > limits.max_total_coders:
            raise exceeded("TotalCoders", limits.max_total_coders, total)
        out.folders.append(folder)
    r.expect(UNPACK_SIZE)
    for folder in out.folders:
        folder["unpack_sizes"] = [r.number() for _ in folder["coders"]]
        folder["unpack_size"] = folder["unpack_sizes"][validate_graph(folder)]
    tag = r.byte()
    if tag == CRC:
        for folder, crc in zip(out.folders, r.crcs(n), strict=True):
            folder["crc"] = crc
        tag = r.byte()
    if tag != END:
        raise corrupted("unpack info doesn't end")


def _sub_streams(r: Reader, limits: ArchiveLimits, out: Streams) -> None:
    tag = r.byte()
    if tag == NUM_UNPACK:
        for folder in out.folders:
            folder["num_sub_streams"] = r.count("SubStreams", limits.max_entries, 0)
        tag = r.byte()
    total = sum(f["num_sub_streams"] for f in out.folders)
    if limits.max_entries is not None and total > limits.max_entries:
        raise exceeded("Entries", limits.max_entries, total)
    for b, folder in enumerate(out.folders):
        n, left = folder["num_sub_streams"], folder["unpack_size"]
        for k in range(n):
            size = left if k == n - 1 else r.number() if tag == SIZE else None
            if size is None or size > left:
                raise corrupted("sub-streams are larger than their block")
            left -= size
            crc = folder["crc"] if n == 1 else None
            out.sub_streams.append({"block_index": b, "ordinal": k, "size": size, "crc": crc})
    if tag == SIZE:
        tag = r.byte()
    while tag != END:
        if tag == CRC:
            own = [s for s in out.sub_streams if s["crc"] is None]
            for s, crc in zip(own, r.crcs(len(own)), strict=True):
                s["crc"] = crc
        else:
            raise corrupted(f"section {tag:#x} among sub-streams")
        tag = r.byte()


def read_streams(r: Reader, limits: ArchiveLimits) -> Streams:
    out, tag, listed = Streams(), r.byte(), False
    if tag == PACK_INFO:
        _pack_info(r, limits, out)
        tag = r.byte()
    if tag == UNPACK_INFO:
        _unpack_info(r, limits, out)
        tag = r.byte()
    if tag == SUB_STREAMS:
        _sub_streams(r, limits, out)
        listed = True
        tag = r.byte()
    if tag != END:
        raise corrupted("streams info doesn't end")
    if not listed:
        out.sub_streams = [{"block_index": b, "ordinal": 0, "size": f["unpack_size"], "crc": f["crc"]} for b, f in enumerate(out.folders)]
    if sum(len(f["packed_streams"]) for f in out.folders) > len(out.pack_sizes):
        raise corrupted("blocks read more pack streams than there are")
    return out


def _names(data: bytes, n: int, limits: ArchiveLimits) -> list[str]:
    if len(data) % 2:
        raise corrupted("names have an odd number of bytes")
    if limits.max_names_bytes is not None and len(data) > limits.max_names_bytes:
        raise exceeded("NamesBytes", limits.max_names_bytes, len(data))
    units = memoryview(data).cast("H") if len(data) else memoryview(b"")
    out, start = [], 0
    for i, unit in enumerate(units):
        if unit == 0:
            raw = data[2 * start : 2 * i]
            if limits.max_name_bytes is not None and len(raw) + 2 > limits.max_name_bytes:
                raise exceeded("NameBytes", limits.max_name_bytes, len(raw) + 2)
            try:
                out.append(raw.decode("utf-16-le"))
            except UnicodeDecodeError:
                raise corrupted("a name is not UTF-16") from None
            start = i + 1
    if len(out) != n or start != len(units):
        raise corrupted(f"{len(out)} names for {n} files")
    return out


def read_files(r: Reader, limits: ArchiveLimits, sub_streams: list[dict]) -> list[dict]:
    n = r.count("Entries", limits.max_entries, 0)
    files: list[dict] = [{"name": "", "ctime_ticks": None, "atime_ticks": None, "mtime_ticks": None, "windows_attributes": None} for _ in range(n)]
    empty: list[bool] = [False] * n
    empty_file: list[bool] = []
    anti: list[bool] = []
    while (tag := r.byte()) != END:
        body = Reader(r.take(r.count("PropertyBytes", limits.max_header_unpacked_bytes)))
        if tag == EMPTY_STREAM:
            empty = body.bits(n)
        elif tag == EMPTY_FILE:
            empty_file = body.bits(sum(empty))
        elif tag == ANTI:
            anti = body.bits(sum(empty))
        elif tag == NAMES:
            if body.byte():
                raise ArchiveError("UnsupportedMethod", "names in an additional stream")
            for f, name in zip(files, _names(body.take(body.left), n, limits), strict=True):
                f["name"] = name
        elif tag in (CTIME, ATIME, MTIME, ATTRIBUTES):
            there = body.defined(n)
            if body.byte():
                raise ArchiveError("UnsupportedMethod", "a property in an additional stream")
            key = {CTIME: "ctime_ticks", ATIME: "atime_ticks", MTIME: "mtime_ticks", ATTRIBUTES: "windows_attributes"}[tag]
            for f, d in zip(files, there, strict=True):
                if d:
                    f[key] = body.u32() if tag == ATTRIBUTES else struct.unpack("<Q", body.take(8))[0]
        elif tag == START_POS:
            raise ArchiveError("UnsupportedMethod", "start positions")
    if sum(not e for e in empty) != len(sub_streams):
        raise corrupted(f"{sum(not e for e in empty)} files with a stream for {len(sub_streams)} sub-streams")
    streams, k = iter(sub_streams), 0
    for i, (f, e) in enumerate(zip(files, empty, strict=True)):
        f |= {"file_index": i, "has_stream": not e, "is_directory": False, "is_anti_item": False, "size": 0, "crc": None}
        if e:
            f["is_directory"] = not (k < len(empty_file) and empty_file[k])
            f["is_anti_item"] = bool(k < len(anti) and anti[k])
            k += 1
        else:
            s = next(streams)
            f["size"], f["crc"] = s["size"], s["crc"]
    return files


@dataclasses.dataclass
class Parsed:
    major: int
    minor: int
    length: int
    next_offset: int
    next_size: int
    next_crc: int
    streams: Streams
    files: list[dict]


def parse(read: Callable[[int, int], bytes], length: int, limits: ArchiveLimits = ArchiveLimits(), password: str | None = None) -> Parsed:  # noqa: B008
    """The header of an archive. read(offset, n) gives bytes, fewer at the end."""
    if limits.archive_bytes is not None and length > limits.archive_bytes:
        raise exceeded("ArchiveBytes", limits.archive_bytes, length)
    start = read(0, HEADER_SIZE)
    if start[:6] != SIGNATURE:
        raise ArchiveError("BadSignature", "not a 7z archive")
    if len(start) < HEADER_SIZE:
        raise corrupted("the start header is cut short")
    major, minor, crc = start[6], start[7], struct.unpack_from("<I", start, 8)[0]
    if major != 0:
        raise ArchiveError("UnsupportedVersion", f"version {major}.{minor}")
    if crc == 0 and not any(start[12:]):
        return _recover(read, length, limits, password, major, minor)
    if zlib.crc32(start[12:]) != crc:
        raise ArchiveError("ChecksumMismatch", "the start header's checksum")
    offset, size, next_crc = struct.unpack_from("<QQI", start, 12)
    if limits.max_header_bytes is not None and size > limits.max_header_bytes:
        raise exceeded("HeaderBytes", limits.max_header_bytes, size)
    if size > length or offset > length or HEADER_SIZE + offset + size > length:
        raise corrupted("the header lies behind the end of the file")
    if not size:
        if offset:
            raise corrupted("an empty header has an offset")
        return Parsed(major, minor, length, 0, 0, next_crc, Streams(), [])
    data = read(HEADER_SIZE + offset, size)
    if len(data) < size or zlib.crc32(data) != next_crc:
        raise ArchiveError("ChecksumMismatch", "the header's checksum")
    streams, files = _header(read, data, length, limits, password, 0)
    return Parsed(major, minor, length, offset, size, next_crc, streams, files)


def _header(read: Callable[[int, int], bytes], data: bytes, length: int, limits: ArchiveLimits, password: str | None, depth: int) -> tuple[Streams, list[dict]]:
    r = Reader(data)
    tag = r.byte()
    if tag == ENCODED:
        if limits.max_header_depth is not None and depth >= limits.max_header_depth:
            raise exceeded("HeaderDepth", limits.max_header_depth, depth + 1)
        inner = read_streams(r, limits)
        if not inner.folders:
            raise corrupted("an encoded header has no block")
        folder = inner.folders[0]
        if any(c["num_in"] != 1 for c in folder["coders"]):
            raise ArchiveError("UnsupportedMethod", "an encoded header with coders of several inputs")
        if limits.max_header_unpacked_bytes is not None and folder["unpack_size"] > limits.max_header_unpacked_bytes:
            raise exceeded("HeaderUnpackedBytes", limits.max_header_unpacked_bytes, folder["unpack_size"])
        at = HEADER_SIZE + inner.pack_pos
        packs = []
        for size in inner.pack_sizes[: len(folder["packed_streams"])]:
            if at + size > length:
                raise corrupted("an encoded header lies behind the end of the file")
            packs.append(read(at, size))
            at += size
        plain = decode_folder(folder, packs, password)
        if folder["crc"] is not None and zlib.crc32(plain) != folder["crc"]:
            raise ArchiveError("ChecksumMismatch", "the encoded header's checksum")
        return _header(read, plain, length, limits, password, depth + 1)
    if tag != HEADER:
        raise corrupted(f"a header begins with {tag:#x}")
    streams, files = Streams(), []
    tag = r.byte()
    if tag == ARCHIVE_PROPERTIES:
        while r.byte() != END:
            r.take(r.count("PropertyBytes", limits.max_header_bytes))
        tag = r.byte()
    if tag == ADDITIONAL:
        raise ArchiveError("UnsupportedMethod", "additional streams")
    if tag == MAIN:
        streams = read_streams(r, limits)
        tag = r.byte()
    if tag == FILES:
        files = read_files(r, limits, streams.sub_streams)
        tag = r.byte()
    elif streams.sub_streams:
        raise corrupted("streams without files")
    if tag != END:
        raise corrupted("the header doesn't end")
    if HEADER_SIZE + streams.pack_pos + sum(streams.pack_sizes) > length:
        raise corrupted("pack streams lie behind the end of the file")
    total = sum(f["unpack_size"] for f in streams.folders)
    if limits.max_unpack_bytes is not None and total > limits.max_unpack_bytes:
        raise exceeded("UnpackBytes", limits.max_unpack_bytes, total)
    packed = sum(streams.pack_sizes)
    if limits.max_unpack_ratio is not None and packed and total > limits.max_unpack_ratio * packed:
        raise exceeded("UnpackRatio", limits.max_unpack_ratio, -(-total // packed))
    power_bound = min(24, limits.max_aes_cycles_power if limits.max_aes_cycles_power is not None else 24)
    for f in streams.folders:
        for c in f["coders"]:
            if codecs.NAMES.get(c["method_id"]) == "AES256_SHA256":
                if not c["properties"]:
                    raise corrupted("AES256 properties too short")
                power = c["properties"][0] & 63
                if power != 63 and power > power_bound:
                    raise exceeded("AesCyclesPower", power_bound, power)
    if limits.reject_unsafe_names:
        for f in files:
            if (why := unsafe_reason(f["name"])) is not None:
                raise ArchiveError("LimitExceeded", why, "UnsafeEntryName", 0, f["file_index"])
    return streams, files


def unsafe_reason(name: str) -> str | None:
    """functions.paths.unsafe_path_reason for one name."""
    from foldlake.functions import paths

    if not name:
        return paths.NO_NAME
    if "\0" in name:
        return paths.HAS_NUL
    if name[0] in "/\\":
        return paths.ABSOLUTE
    for part in name.replace("\\", "/").split("/"):
        if part == "..":
            return paths.WALKS_OUT
        if len(part) > 1 and part[1] == ":" and part[0].isascii() and part[0].isalpha():
            return paths.DRIVE
    return None


def _recover(read, length: int, limits: ArchiveLimits, password: str | None, major: int, minor: int) -> Parsed:
    """A start header of zeros: each byte of the file's last MiB that could begin a header is tried as
    one, the last first, and the first with files counts. A candidate that can't be parsed ends the
    search with its error, and so does one that would be longer than a header may be."""
    begin = max(HEADER_SIZE, length - RECOVERY_BYTES)
    tail = read(begin, length - begin)
    longest = len(tail) if limits.max_header_bytes is None else limits.max_header_bytes
    for i in range(len(tail) - 2, -1, -1):
        if tail[i] not in (HEADER, ENCODED):
            continue
        data = tail[i:]
        if len(data) > longest:
            raise exceeded("HeaderBytes", longest, len(data))
        streams, files = _header(read, data, length, limits, password, 0)
        if files:
            return Parsed(major, minor, length, begin + i - HEADER_SIZE, len(data), zlib.crc32(data), streams, files)
    raise corrupted("no header was found")


def decode_folder(folder: dict, packs: list[bytes], password: str | None = None) -> bytes:
    """A block's bytes out of its packed streams, along its coder graph."""
    coders = folder["coders"]
    first, at = [], 0
    for c in coders:
        first.append(at)
        at += c["num_in"]
    source = {p["in_index"]: p["out_index"] for p in folder["bind_pairs"]}
    packed = dict(zip(folder["packed_streams"], packs, strict=True))

    def output(k: int) -> bytes:
        c = coders[k]
        inputs = [output(source[i]) if i in source else packed[i] for i in range(first[k], first[k] + c["num_in"])]
        method, size = codecs.NAMES.get(bytes(c["method_id"])), folder["unpack_sizes"][k]
        if len(inputs) != 1:
            if method == "BCJ2":
                from foldlake.functions import bcj2

                return bcj2.decode(inputs, size)
            raise ArchiveError("UnsupportedMethod", f"{method} with {len(inputs)} inputs")
        return codecs.decode(method, bytes(c["properties"]), inputs[0], size, password)

    return output(validate_graph(folder))


# Writing


def number(x: int) -> bytes:
    for n in range(8):
        if x < 1 << (7 * (n + 1)):
            mask = (0xFF00 >> n) & 0xFF
            return bytes([mask | x >> (8 * n)]) + (x & ((1 << (8 * n)) - 1)).to_bytes(n, "little")
    return b"\xff" + x.to_bytes(8, "little")


def bit_vector(bits: list[bool]) -> bytes:
    out = bytearray((len(bits) + 7) // 8)
    for i, b in enumerate(bits):
        if b:
            out[i >> 3] |= 0x80 >> (i & 7)
    return bytes(out)


def digests(crcs: list[int | None]) -> bytes:
    there = [c is not None for c in crcs]
    return (b"\1" if all(there) else b"\0" + bit_vector(there)) + b"".join(struct.pack("<I", c) for c in crcs if c is not None)


def write_folder(folder: dict) -> bytes:
    out = number(len(folder["coders"]))
    for c in folder["coders"]:
        simple = c["num_in"] == 1 and c["num_out"] == 1
        out += bytes([len(c["method_id"]) | (0 if simple else 0x10) | (0x20 if c["properties"] else 0)]) + c["method_id"]
        if not simple:
            out += number(c["num_in"]) + number(c["num_out"])
        if c["properties"]:
            out += number(len(c["properties"])) + c["properties"]
    for p in folder["bind_pairs"]:
        out += number(p["in_index"]) + number(p["out_index"])
    if len(folder["packed_streams"]) > 1:
        out += b"".join(map(number, folder["packed_streams"]))
    return out


def write_streams(pack_pos: int, pack_sizes: list[int], pack_crcs: list[int | None], folders: list[dict], subs: list[list[tuple[int, int | None]]] | None) -> bytes:
    """subs: of each block (size, crc) of its sub-streams; None for a header's own stream."""
    out = b""
    if pack_sizes:
        out += bytes([PACK_INFO]) + number(pack_pos) + number(len(pack_sizes)) + bytes([SIZE]) + b"".join(map(number, pack_sizes))
        if any(c for c in pack_crcs):  # a CRC of 0 is left out here
            out += bytes([CRC]) + digests([c or None for c in pack_crcs])
        out += bytes([END])
    if folders:
        out += bytes([UNPACK_INFO, FOLDER]) + number(len(folders)) + b"\0" + b"".join(map(write_folder, folders))
        out += bytes([UNPACK_SIZE]) + b"".join(number(s) for f in folders for s in f["unpack_sizes"])
        if any(f["crc"] is not None for f in folders):
            out += bytes([CRC]) + digests([f["crc"] for f in folders])
        out += bytes([END])
        if subs is not None:
            out += bytes([SUB_STREAMS])
            if any(len(s) != 1 for s in subs):
                out += bytes([NUM_UNPACK]) + b"".join(number(len(s)) for s in subs)
            sizes = b"".join(number(size) for s in subs for size, _ in s[:-1])
            if sizes:
                out += bytes([SIZE]) + sizes
            own = [crc for f, s in zip(folders, subs, strict=True) for _, crc in s if not (len(s) == 1 and f["crc"] is not None)]
            if own:
                out += bytes([CRC]) + digests(own)
            out += bytes([END])
    return out + bytes([END])


def write_files(files: list[dict]) -> bytes:
    out = number(len(files))

    def prop(tag: int, body: bytes) -> bytes:
        return bytes([tag]) + number(len(body)) + body

    empty = [not f["has_stream"] for f in files]
    if any(empty):
        out += prop(EMPTY_STREAM, bit_vector(empty))
        without = [f for f in files if not f["has_stream"]]
        if any(not f.get("is_directory") for f in without):
            out += prop(EMPTY_FILE, bit_vector([not f.get("is_directory") for f in without]))
        if any(f.get("is_anti_item") for f in without):
            out += prop(ANTI, bit_vector([bool(f.get("is_anti_item")) for f in without]))
    out += prop(NAMES, b"\0" + b"".join((f["name"] + "\0").encode("utf-16-le") for f in files))
    for tag, key, form in ((CTIME, "ctime_ticks", "<Q"), (ATIME, "atime_ticks", "<Q"), (MTIME, "mtime_ticks", "<Q"), (ATTRIBUTES, "windows_attributes", "<I")):
        values = [f.get(key) for f in files]
        if any(v is not None for v in values):
            there = [v is not None for v in values]
            out += prop(tag, (b"\1" if all(there) else b"\0" + bit_vector(there)) + b"\0" + b"".join(struct.pack(form, int(v)) for v in values if v is not None))
    return out + bytes([END])


def write_header(pack_pos: int, pack_sizes: list[int], pack_crcs: list[int | None], folders: list[dict], subs: list[list[tuple[int, int | None]]], files: list[dict]) -> bytes:
    out = bytes([HEADER])
    if folders:
        out += bytes([MAIN]) + write_streams(pack_pos, pack_sizes, pack_crcs, folders, subs)
    if files:
        out += bytes([FILES]) + write_files(files)
    return out + bytes([END])


def chain_folder(coders: list[tuple[str, bytes, int]]) -> dict:
    """A folder of coders that each read the next one's output; the last reads the packed stream."""
    n = len(coders)
    return {
        "coders": [{"method_id": codecs.IDS[m], "num_in": 1, "num_out": 1, "properties": p} for m, p, _ in coders],
        "bind_pairs": [{"in_index": k, "out_index": k + 1} for k in range(n - 1)],
        "packed_streams": [n - 1], "unpack_sizes": [s for _, _, s in coders], "unpack_size": coders[0][2], "crc": None,
    }


def bcj2_folder(coders: list[tuple[str, bytes, int]]) -> dict:
    """A folder of BCJ2 and the coders of its first three inputs; the fourth is packed as it is."""
    return {
        "coders": [{"method_id": codecs.IDS[m], "num_in": 4 if k == 0 else 1, "num_out": 1, "properties": p} for k, (m, p, _) in enumerate(coders)],
        "bind_pairs": [{"in_index": k, "out_index": k + 1} for k in range(3)],
        "packed_streams": [4, 5, 6, 3], "unpack_sizes": [s for _, _, s in coders], "unpack_size": coders[0][2], "crc": None,
    }


def close(header: bytes, at: int, compress: bool = True, password: str | None = None) -> tuple[bytes, bytes]:
    """(start header, what follows the packed streams that end at `at` bytes behind the start
    header). The header is packed with LZMA, and encrypted with a password; it stays plain where that
    isn't smaller and no password is given."""
    tail = header
    if compress and (len(header) > 64 or password is not None):
        methods = [("LZMA", codecs.Options())] + ([("AES256_SHA256", codecs.Options())] if password is not None else [])
        coders, packed = codecs.encode_chain(methods, header, password)
        folder = chain_folder(coders)
        folder["crc"] = zlib.crc32(header)
        if password is not None or len(packed) + 20 < len(header):
            encoded = bytes([ENCODED]) + write_streams(at, [len(packed)], [None], [folder], None)
            tail = packed + encoded
            header = encoded
    offset = at + len(tail) - len(header)
    fields = struct.pack("<QQI", offset, len(header), zlib.crc32(header))
    return SIGNATURE + b"\0\4" + struct.pack("<I", zlib.crc32(fields)) + fields, tail
