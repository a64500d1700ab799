"""Entry names: what makes one unsafe, and how it becomes a path. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The reasons, in the words that users of the format's tools know.
NO_NAME = "the entry has no name"
HAS_NUL = "the name contains a NUL"
ABSOLUTE = "the name is an absolute path"
WALKS_OUT = "the name walks out of the extraction directory"
DRIVE = "the name names a drive"


def components(name: Column) -> Column:
    return F.split(name, r"[/\\]")


def unsafe_path_reason(name: Column) -> Column:
    """The first reason that applies, or null. Among components the first offending one decides."""
    each = F.transform(components(name), lambda c: F.when(c == "..", WALKS_OUT).when(c.rlike("^[A-Za-z]:"), DRIVE))
    return (
        F.when(name == "", NO_NAME)
        .when(F.instr(name, "\0") > 0, HAS_NUL)
        .when(name.startswith("/") | name.startswith("\\"), ABSOLUTE)
        .otherwise(F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0)))
    )


def is_unsafe_path(name: Column) -> Column:
    return unsafe_path_reason(name).isNotNull()


def safe_path(name: Column) -> Column:
    """The relative path an entry is extracted to, with `/` and without `.`; null if it is unsafe or
    nothing remains."""
    kept = F.filter(components(name), lambda c: (c != "") & (c != "."))
    return F.when(~is_unsafe_path(name) & (F.size(kept) > 0), F.array_join(kept, "/"))


def archive_name(path: Column, root: Column) -> Column:
    """A file's name in an archive that is made from the folder `root`."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.concat(F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))
    return F.when(plain.startswith(base), F.substring(plain, F.length(base) + 1, F.length(plain))).otherwise(F.ltrim(plain, F.lit("/")))


def name_bytes(name: Column) -> Column:
    """What a name takes in a header: UTF-16LE with its end."""
    return F.octet_length(F.encode(name, "UTF-16LE")) + 2
