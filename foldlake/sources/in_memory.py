"""Archives that are values: bytes in, members out, and back. The output that an archive may declare
is bounded, as all of it is held."""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterable, Iterator

from foldlake.functions.errors import ArchiveError
from foldlake.operators.limits import ArchiveLimits
from foldlake.sources import archives, header, writer

#: Bytes that an archive may declare.
MAX_UNPACK_BYTES = 1 << 30


def unpack(content: bytes, password: str | None = None, limits: ArchiveLimits = ArchiveLimits(max_unpack_bytes=MAX_UNPACK_BYTES)) -> Iterator[tuple[str, bytes]]:  # noqa: B008
    """(name, data) of the members that aren't folders, in the archive's order of blocks; a name that
    isn't safe is refused, and so is an archive that declares more than it may."""
    if limits.max_unpack_bytes is None:
        limits = dataclasses.replace(limits, max_unpack_bytes=MAX_UNPACK_BYTES)
    read = lambda at, n: content[at : at + n]
    row = archives.rows_of("", header.parse(read, len(content), limits, password))
    for e in row["entries"]:
        if not e["is_directory"] and (why := header.unsafe_reason(e["name"])) is not None:
            raise ArchiveError("LimitExceeded", why, "UnsafeEntryName", 0, e["file_index"])
    at, first = 0, 0
    streamed = iter([e for e in row["entries"] if e["has_stream"]])
    for b in row["blocks"]:
        members = [next(streamed) for _ in range(b["num_sub_streams"])]
        packs = []
        for p in row["pack_streams"][first : first + b["num_packed"]]:
            packs.append({"offset": at, "size": p["size"]})
            at += p["size"]
        first += b["num_packed"]
        plan = {**b, "archive_id": "", "block_crc": b["crc"], "packs": packs, "members": members, "pack_pos": row["pack_pos"]}
        held: dict[int, list[bytes]] = {}
        for r in archives.decode_block(plan, read, password, True, archives.CHUNK):
            if r["error"]:
                code, _, message = r["error"].partition(": ")
                raise ArchiveError(code, message)
            held.setdefault(r["file_index"], []).append(r["data"])
        for m in members:
            yield m["name"], b"".join(held.get(m["file_index"], []))
    for e in row["entries"]:
        if not e["has_stream"] and not e["is_directory"]:
            yield e["name"], b""


def pack(members: Iterable[tuple[str, bytes]], methods: writer.Methods = writer.DEFAULT, password: str | None = None, solid: bool = False) -> bytes:
    """An archive of (name, data), a block for each or one for all."""
    writer.check_methods(methods)
    rows = [{"name": n, "data": d} for n, d in members]
    blocks = [writer._prepare("", 0, group, methods, password) for group in ([rows] if solid and rows else [[r] for r in rows])]
    sizes, crcs, folders, subs, packed, entries = [], [], [], [], b"", []
    for b in blocks:
        found = [(c["method"], c["properties"], c["size"]) for c in b["coders"]]
        folder = header.bcj2_folder(found) if b["pack_sizes"] else header.chain_folder(found)
        streams = [m for m in b["members"] if m["has_stream"]]
        folder["crc"] = b["crc"] if len(streams) == 1 else None
        at = 0
        for size in b["pack_sizes"] or [len(b["packed"])]:
            sizes.append(size)
            crcs.append(zlib.crc32(b["packed"][at : at + size]))
            at += size
        folders.append(folder)
        subs.append([(m["size"], m["crc"]) for m in streams])
        packed += b["packed"]
        entries += b["members"]
    if not entries:
        return header.SIGNATURE + b"\0\4" + writer._empty()
    start, tail = header.close(header.write_header(0, sizes, crcs, folders, subs, entries), len(packed), True, password)
    return start + packed + tail
