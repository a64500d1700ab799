"""Checksums: verification by joins, and folding of CRC-32 over pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foldlake.functions.crc import combine


def verify(expected: DataFrame, computed: DataFrame, *key: str) -> DataFrame:
    """key, expected, actual, where both are there and differ. A null expectation checks nothing."""
    rows = expected.select(*key, F.col("crc").alias("expected")).join(computed.select(*key, F.col("crc").alias("actual")), list(key))
    return rows.where("expected is not null and expected <> actual")


def reported_against_expected(reported: DataFrame, expected: DataFrame, *key: str) -> DataFrame:
    """key, problem: unexpected, missing, duplicate or mismatch; sound keys aren't listed."""
    got = reported.groupBy(*key).agg(F.count("*").alias("n"), F.min("crc").alias("low"), F.max("crc").alias("high"))
    rows = got.join(expected.select(*key, F.col("crc").alias("crc"), F.lit(True).alias("wanted")), list(key), "full")
    problem = (
        F.when(F.col("wanted").isNull(), "unexpected")
        .when(F.col("n").isNull(), "missing")
        .when(F.col("n") > 1, "duplicate")
        .when(~F.col("low").eqNullSafe(F.col("crc")), "mismatch")
    )
    return rows.select(*key, problem.alias("problem")).where("problem is not null")


def digest_agreement(decodes: DataFrame) -> DataFrame:
    """decodes (fixture, seq, digest) that differ from the first of their fixture."""
    w = Window.partitionBy("fixture").orderBy("seq")
    return decodes.withColumn("first_digest", F.first("digest").over(w)).where("digest <> first_digest")


def fold(pieces: DataFrame, *key: str) -> DataFrame:
    """key, offset, len, crc of the pieces' union where they tile it without a gap; else crc null.
    pieces: key, offset, len, crc. CRC-32 of a whole follows from its pieces in order by an
    associative operation, so pieces are first folded where they are (runs of neighbours in a task),
    and what meets for a key are the folded runs."""
    spark = pieces.sparkSession
    fields = pieces.select(*key, F.col("offset").cast("long"), F.col("len").cast("long"), F.col("crc").cast("long"))
    schema = fields.schema
    names = list(key)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(batch.to_pylist(), key=lambda r: (*(str(r[k]) for k in names), r["offset"]))
            out: list[dict] = []
            for r in rows:
                last = out[-1] if out else None
                if last and all(last[k] == r[k] for k in names) and last["offset"] + last["len"] == r["offset"] and last["crc"] is not None and r["crc"] is not None:
                    last["crc"], last["len"] = combine(last["crc"], r["crc"], r["len"]), last["len"] + r["len"]
                else:
                    out.append(dict(r))
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    def whole(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["offset"])
        first = rows[0]
        at, crc = first["offset"], 0
        for r in rows:
            crc = combine(crc, r["crc"], r["len"]) if crc is not None and r["crc"] is not None and r["offset"] == at else None
            at = r["offset"] + r["len"] if crc is not None else max(at, r["offset"] + r["len"])
        return pa.Table.from_pylist([{**{k: first[k] for k in names}, "offset": first["offset"], "len": at - first["offset"], "crc": crc}], table.schema)

    from foldlake.sources.shipping import ship

    ship(spark)
    return fields.mapInArrow(runs, schema).groupBy(*key).applyInArrow(whole, schema)


# Kinds of errors.
PASS_THROUGH = ["LimitExceeded", "WindowAllocatorFailed", "Cancelled", "InvalidArgument", "Internal"]


def classify(errors: DataFrame) -> DataFrame:
    """errors (code, block_has_aes) with kind: what an error means once it happened in a block.
    A wrong password is suspected of a block with an AES coder, whether one was given or not."""
    code, aes = F.col("code"), F.col("block_has_aes")
    damaged = code.isin("Corrupted", "ChecksumMismatch", "UnexpectedEnd", "BadHeader")
    kind = (
        F.when(code.isin(*PASS_THROUGH), code)
        .when(damaged & aes, "Password")
        .when(code == "ChecksumMismatch", "ChecksumMismatch")
        .when(damaged, "Corrupted")
        .when(code == "UnsupportedMethod", code)
        .when(code.isin("Password", "PasswordRequired", "MaybeBadPassword"), "Password")
        .otherwise("Io")
    )
    return errors.withColumn("kind", kind)


def first_error(errors: DataFrame) -> DataFrame:
    """For each archive the error of its first failing block in archive order."""
    rest = [c for c in errors.columns if c != "archive_id"]
    return errors.groupBy("archive_id").agg(F.min_by(F.struct(*rest), "block_index").alias("x")).select("archive_id", "x.*")
