"""Table functions for SQL: `SELECT * FROM list_entries(content)`, `unpack_archive(content)`,
`lzma2_runs(stream)`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class ListEntries:
    """The entries of an archive that is a value: a row each, or one with the error."""

    def eval(self, content: bytes):
        from foldlake.functions.errors import ArchiveError
        from foldlake.sources import header

        try:
            parsed = header.parse(lambda at, n: content[at : at + n], len(content))
        except ArchiveError as e:
            yield None, None, None, None, str(e)
            return
        for f in parsed.files:
            yield f["file_index"], f["name"], f["size"], f["crc"], None


class Lzma2Runs:
    """The closed runs of an LZMA2 stream that is a value."""

    def eval(self, stream: bytes):
        from foldlake.functions import lzma2
        from foldlake.streaming.runs import advance

        _, closed = advance(None, list(lzma2.chunks(stream)))
        for run, packed_offset, packed_size, output_offset, output_len, lzma in closed:
            yield run, packed_offset, packed_size, output_offset, output_len, output_len > 0 and lzma * 64 <= output_len


class UnpackArchive:
    """The members of an archive that is a value, if it declares no more than a GiB."""

    def eval(self, content: bytes):
        from foldlake.functions.errors import ArchiveError
        from foldlake.sources import in_memory

        try:
            for name, data in in_memory.unpack(content):
                yield name, data, None
        except ArchiveError as e:
            yield None, None, str(e)


def register(spark: SparkSession) -> None:
    from foldlake.sources.shipping import ship

    ship(spark)
    spark.udtf.register("list_entries", udtf(ListEntries, returnType="file_index long, name string, size long, crc long, error string"))
    spark.udtf.register("unpack_archive", udtf(UnpackArchive, returnType="name string, data binary, error string"))
    spark.udtf.register("lzma2_runs", udtf(Lzma2Runs, returnType="run_index long, packed_offset long, packed_size long, output_offset long, output_len long, stored boolean"))
