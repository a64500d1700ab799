"""Context-triggered piecewise hashing of whole texts, and their likeness by edit distance.

A rolling hash over seven bytes ends a piece wherever its low k bits are ones; each piece becomes
one of 64 symbols. k grows with the text so that a signature has about 24 to 48 symbols, 64 at most
(the last piece then takes the rest). The fingerprint `k:signature:signature at k+1` can be compared
with those of the same k and of its neighbours. Likeness is one less the edit distance over the
longer signature, and zero for signatures without a common run of `RUN` symbols. Distances are
computed for many pairs at once, a column of a pair's table in the bits of one word.

`neighbours` gives for each document its fingerprint, that of an edited text whose last third is the
start of the next document (descending doc_id), and the likeness of both. The rows are range
partitioned and sorted once; a partition's last row meets the first row of the next in a second,
small step over two rows for each partition.

Defined results: a null text is empty; two empty texts are alike (1); of equal doc_ids the order is
by a hash of the text, then the text; a null doc_id comes last; a single row is its own next row; an
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common

WINDOW = 7
TARGET, LONGEST = 48, 64
RUN = 4
# The symbols of a signature.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_VALUE = np.full(128, 0, np.uint8)
_VALUE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(64, dtype=np.uint8)
_BASE = 0x9E3779B1  # odd, so that it has an inverse modulo 2**32


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint32)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint32(1)], np.cumprod(np.full(n - 1, _BASE, np.uint32), dtype=np.uint32)])
                self.down = np.concatenate([[np.uint32(1)], np.cumprod(np.full(n - 1, pow(_BASE, -1, 1 << 32), np.uint32), dtype=np.uint32)])
        return self.up, self.down


_powers = Powers()


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of the window that ends with it: the polynomial of the window, from
    differences of one running sum, then mixed."""
    up, down = _powers.of(len(data))
    run = np.cumsum((data.astype(np.uint32) + np.uint32(1)) * down[: len(data)], dtype=np.uint32)
    run[WINDOW:] -= run[:-WINDOW].copy()
    run *= up[: len(data)]
    run ^= run >> np.uint32(15)
    run *= np.uint32(0x85EBCA6B)
    run ^= run >> np.uint32(13)
    return run


def _signature(data: bytes, ends: list[int]) -> str:
    if len(ends) >= LONGEST:
        ends = ends[: LONGEST - 1]
    if data and (not ends or ends[-1] < len(data)):
        ends = [*ends, len(data)]
    crc, out, start = zlib.crc32, [], 0
    for end in ends:
        out.append(SYMBOLS[crc(data[start:end]) >> 26])
        start = end
    return "".join(out)


def _fingerprint(data: bytes, hashes: np.ndarray) -> str:
    k = max(0, (max(1, len(data)) // TARGET).bit_length())
    while True:
        low = np.uint32((1 << k) - 1)
        ends = np.flatnonzero((hashes & low) == low)
        if k == 0 or len(ends) >= TARGET // 3:
            break
        k -= 1
    more = np.uint32((2 << k) - 1)
    rarer = ends[(hashes[ends] & more) == more]
    return f"{k}:{_signature(data, (ends + 1).tolist())}:{_signature(data, (rarer + 1).tolist())}"


def fingerprints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text (its UTF-8)."""
    # all texts in one array, each after a window of zeros, so that no window holds two of them
    gap = bytes(WINDOW)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    hashes, out, at = rolling(data), [], WINDOW
    for t in texts:
        out.append(_fingerprint(t, hashes[at : at + len(t)]))
        at += len(t) + WINDOW
    return out


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances (insert, delete, replace) of pairs of signatures of up to 64 symbols: Myers'
    bit-vector algorithm (1999) over all pairs at once."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    u8 = np.uint64

    def table(x: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = np.frombuffer("".join(s.ljust(LONGEST) for s in x).encode(), np.uint8)
        return _VALUE[joined].reshape(n, LONGEST), np.fromiter(map(len, x), np.int64, n)

    (va, la), (vb, lb) = table(a), table(b)
    rows = np.arange(n)
    match = np.zeros((n, 64), u8)
    for i in range(int(la.max())):
        on = np.flatnonzero(la > i)
        match[on, va[on, i]] |= u8(1 << i)
    top = u8(1) << np.maximum(la - 1, 0).astype(u8)
    plus, minus, score, one = np.full(n, ~u8(0)), np.zeros(n, u8), la.copy(), u8(1)
    with np.errstate(over="ignore"):
        for j in range(int(lb.max())):
            eq = match[rows, vb[:, j]]
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus), plus & xh
            on = lb > j
            score += on * ((ph & top != 0).astype(np.int64) - (mh & top != 0))
            ph, mh = (ph << one) | one, mh << one
            plus, minus = np.where(on, mh | ~(xv | ph), plus), np.where(on, ph & xv, minus)
    return np.where(la == 0, lb, score)


def _run_in_common(a: str, b: str) -> bool:
    size = min(RUN, len(a), len(b))
    runs = {a[i : i + size] for i in range(len(a) - size + 1)}
    return any(b[i : i + size] in runs for i in range(len(b) - size + 1))


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """Likeness of pairs of fingerprints, 0 to 1: of the signatures that both have at one k the most
    alike; 0 if there is none."""
    best = [0.0] * len(pairs)
    at, left, right = [], [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            best[i] = 1.0
            continue
        kx, *sx = x.split(":")
        ky, *sy = y.split(":")
        k, m = int(kx), int(ky)
        for s, u in [(sx[0], sy[0]), (sx[1], sy[1])] if k == m else [(sx[0], sy[1])] if k == m + 1 else [(sx[1], sy[0])] if m == k + 1 else []:
            if s and u and _run_in_common(s, u):
                at.append(i)
                left.append(s)
                right.append(u)
    found = distances(left, right)
    for i, s, u, d in zip(at, left, right, found.tolist(), strict=True):
        best[i] = max(best[i], 1 - d / max(len(s), len(u)))
    return best


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _results(ids: list, texts: list[str]) -> dict[str, list]:
    """Of each row but the last, whose next row isn't known here."""
    own = fingerprints([t.encode() for t in texts])
    changed = [edited(t, u).encode() for t, u in zip(texts, texts[1:], strict=False)]
    theirs = fingerprints(changed)
    near = likeness([*zip(own, theirs, strict=False), *zip(own, own[1:], strict=False)])
    n = len(changed)
    return {
        "doc_id": ids[:n],
        "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
        "fingerprint": own[:n],
        "edited_fingerprint": theirs,
        "near_edited": near[:n],
        "near_next": near[n:],
    }


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    common.ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    by = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    rows = rows.repartitionByRange(common.shuffle_partitions(spark), *by).sortWithinPartitions(*by, "text").select("doc_id", "text")
    whole = f"doc_id {kind}, {COLUMNS}"
    # edge: null for a finished row; 0, 1 for a partition's first and last rows, which carry their text
    schema = pa.schema([("doc_id", rows_type(docs)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def edge(i: int, row: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"doc_id": row[0], "text": row[1], "part": part, "edge": i}], schema)

        for batch in common.slices(batches, "text", 2000, 8 << 20):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if last is None:
                yield edge(0, (ids[0], texts[0]))
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = ids[-1], texts[-1]
            found = _results(ids, texts)
            n = len(found["doc_id"])
            yield pa.RecordBatch.from_pydict({**found, "part": [part] * n, "edge": [None] * n, "text": [None] * n}, schema)
        if last is not None:
            yield edge(1, last)

    found = common.written(rows.mapInArrow(run, f"{whole}, part int, edge int, text string"), "piecewise")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["edge"] == 1:
                    last = row
                elif last is None:
                    first = row
                else:
                    yield pa.RecordBatch.from_pydict(_results([last["doc_id"], None], [last["text"], row["text"]]), done)
        if last is not None:
            yield pa.RecordBatch.from_pydict(_results([last["doc_id"], None], [last["text"], first["text"]]), done)

    done = pa.schema(list(schema)[:7])
    edges = found.where("edge is not null").select("doc_id", "text", "part", "edge").repartition(1).sortWithinPartitions("part", "edge")
    return found.where("edge is null").select("doc_id", *done.names[1:]).unionByName(edges.mapInArrow(close, whole))


def rows_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)
