"""Bytes of files at places, from any store that pyarrow can open: local, HDFS, S3, GCS."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyarrow import fs


# What Arrow calls the schemes of Hadoop's file systems.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    scheme, colon, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if colon else os.path.abspath(path))


@contextmanager
def opened(path: str | list[str]):
    """(read(offset, n), length) of a file, or of volumes as one."""
    volumes = [path] if isinstance(path, str) else path
    files, starts, at = [], [], 0
    try:
        for v in volumes:
            store, name = resolve(v)
            files.append(store.open_input_file(name))
            starts.append(at)
            at += files[-1].size()

        def read(offset: int, n: int) -> bytes:
            out = []
            for f, start, end in zip(files, starts, [*starts[1:], at], strict=True):
                if n > 0 and start <= offset < end:
                    part = f.read_at(min(n, end - offset), offset - start)
                    out.append(part)
                    offset, n = offset + len(part), n - len(part)
            return b"".join(out)

        yield read, at
    finally:
        for f in files:
            f.close()


def listed(paths: Iterable[str], suffix: str = ".7z") -> list[str]:
    """The files themselves, and those below folders, sorted."""
    out = []
    for p in paths:
        store, name = resolve(p)
        info = store.get_file_info(name)
        if info.type == fs.FileType.Directory:
            prefix = p.rstrip("/")
            found = store.get_file_info(fs.FileSelector(name, recursive=True))
            out += sorted(prefix + f.path[len(name.rstrip("/")) :] for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))
        else:
            out.append(p)
    return out


def size(path: str) -> int:
    """The bytes of a file; 0 where there is none."""
    store, name = resolve(path)
    return store.get_file_info(name).size or 0


def there(path: str) -> bool:
    store, name = resolve(path)
    return store.get_file_info(name).type != fs.FileType.NotFound


def write_whole(path: str, chunks: Iterable[bytes]) -> None:
    """A file that is there whole or not at all."""
    store, name = resolve(path)
    part = f"{name}.part-{os.getpid()}"
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
    store.move(part, name)


Read = Callable[[int, int], bytes]
