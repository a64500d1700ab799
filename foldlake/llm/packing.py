"""Packing into windows by minimum bin slack over counts of lengths.

Each document's ids and its end id are cut into pieces of a whole window and a rest. Only the counts
of piece lengths (as many numbers as a window has places) reach the driver. There, again and again,
the longest length left is set and a bitset dynamic program over the others, bounded by their counts,
finds the multiset that fills the window closest to its end; backtracking gives how many of each
length it takes, and the same filling is repeated as long as the counts allow. Where slack remains,
nothing that is left is short enough for it: the longest piece left is cut there, and its rest goes
back to the counts. So one window at most is not full, however alike the lengths are, and the
fillings are a few for each length, however many documents there are.

Pieces get their places without a global order: a piece's rank among those of its length is its rank
in its task plus the counts of the tasks before it, and the table of fillings turns length and rank
into sequence and offset.

Defined results: a null or empty text has the end id alone; equal rows are packed as separate
documents; an empty table gives an empty result. Only doc_id and text are read. A row's pieces cover
each of its ids once.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import common, tokens

WINDOW = 1024
END_ID = 0
#: Rows that are encoded at once.
ROWS = 1000


def fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset (length: count) with the longest length whose sum is closest to the window."""
    longest = max(counts)
    room = window - longest
    reach, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        take = 1
        while left > 0 and not reach >> room & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & limit
            left -= take
            take *= 2
    total, found = reach.bit_length() - 1, Counter({longest: 1})
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            found[length] += take
    return dict(found)


class Slots:
    """Where pieces go. A class is (length of the piece, ids of it that are placed already); its
    ranks are dealt out in ranges."""

    def __init__(self, counts: dict[int, int], window: int = WINDOW):
        self.window, self.sequences = window, 0
        # of a class: first rank, how many, number of the first in its filling, copies a window,
        # first sequence, offset, ids taken, and what a rank becomes in the class of the rest
        self.of: dict[tuple[int, int], list[tuple[int, ...]]] = {}
        self.ranks: Counter[tuple[int, int]] = Counter()
        # of a length: ranges of ranks of the classes that have it
        self.left: dict[int, list[tuple[tuple[int, int], int, int]]] = {}
        self.counts: Counter[int] = Counter()
        for length, n in counts.items():
            if n:
                self._add((length, 0), n)
        while self.counts:
            self._fill()

    def _add(self, kind: tuple[int, int], n: int) -> int:
        low, length = self.ranks[kind], kind[0] - kind[1]
        self.ranks[kind] += n
        self.left.setdefault(length, []).append((kind, low, n))
        self.counts[length] += n
        return low

    def _take(self, length: int, n: int) -> list[tuple[tuple[int, int], int, int]]:
        """Ranges of n pieces of a length."""
        out, ranges = [], self.left[length]
        while n:
            kind, low, size = ranges.pop()
            used = min(size, n)
            if used < size:
                ranges.append((kind, low + used, size - used))
            out.append((kind, low, used))
            n -= used
            self.counts[length] -= used
        if not self.counts[length]:
            del self.counts[length]
        return out

    def _fill(self) -> None:
        found = fill(self.counts, self.window)
        slack = self.window - sum(length * n for length, n in found.items())
        cut = max((length for length, n in self.counts.items() if n > found.get(length, 0)), default=0) if slack else 0
        need = Counter(found)
        need[cut] += bool(cut)
        times = min(self.counts[length] // n for length, n in need.items() if n)
        offset = 0
        for length, n in sorted(found.items(), reverse=True):
            at = 0
            for kind, low, size in self._take(length, n * times):
                self.of.setdefault(kind, []).append((low, size, at, n, self.sequences, offset, length, 0))
                at += size
            offset += length * n
        if cut:
            at = 0
            for kind, low, size in self._take(cut, times):
                rest = self._add((kind[0], kind[1] + slack), size)
                self.of.setdefault(kind, []).append((low, size, at, 1, self.sequences, offset, slack, rest - low))
                at += size
        self.sequences += times

    def sort(self) -> None:
        for ranges in self.of.values():
            ranges.sort()

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the parts of a piece."""
        out, done = [], 0
        while done < length:
            ranges = self.of[length, done]
            low, _, at, n, first, offset, taken, shift = ranges[bisect_right(ranges, (rank, math.inf)) - 1]
            k = at + rank - low
            out.append((done, taken, first + k // n, offset + k % n * taken))
            done, rank = done + taken, rank + shift
        return out


def encoded(batches: Iterator[pa.RecordBatch], own: tokens.PieceEncoder, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches in slices, with their ids and bounds; memory of a slice is given back after it."""
    for batch in common.slices(batches, "text", ROWS, tokens.CHARS):
        yield batch, *own.encode(batch.column("text"), end_id)
        common.release()


def pieces(docs: DataFrame, spec: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, the ids of a rest, and the piece's task and rank
    among the task's pieces of its length."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = tokens.encoder(shared.value), TaskContext.get().partitionId()
        ranks: Counter[int] = Counter()
        for batch, ids, bounds in encoded(batches, own, end_id):
            totals = np.diff(bounds)
            cuts = -(-totals // window)
            at = np.repeat(np.arange(len(batch)), cuts)
            start = (np.arange(len(at)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * window
            length = np.minimum(totals[at] - start, window)
            rank, crcs, rests = [], [], []
            narrow, wide = memoryview(ids.tobytes()), memoryview(ids.astype("<u4").tobytes())
            size = own.kind.itemsize
            for a, n in zip((bounds[at] + start).tolist(), length.tolist(), strict=True):
                crcs.append(zlib.crc32(wide[4 * a : 4 * (a + n)]))
                rests.append(bytes(narrow[size * a : size * (a + n)]) if n < window else None)
                rank.append(ranks[n])
                ranks[n] += 1
            columns = [pa.array(x, pa.int64()) for x in (start, length, crcs, totals[at], np.full(len(at), task), rank)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank", "ids"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *columns, pa.array(rests, pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long, ids binary")


def pack(docs: DataFrame, spec: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    cut = common.written(pieces(docs, spec, window, end_id), "pieces")
    by_task = common.written(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    # one count for each length up to the window
    slots = Slots({r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    slots.sort()
    # ranges of ranks: a few for each length up to the window
    shared = spark.sparkContext.broadcast(slots)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # a table of a known size: whether it is broadcast is for the planner's threshold to say
    offsets = common.written(by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")), "offsets")
    ranked = cut.join(offsets, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "task")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value.places
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            names = ("start", "length", "ids_crc32", "doc_tokens", "rank", "ids")
            for i, (start, length, crc, total, rank, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                parts = places(length, rank)
                if len(parts) > 1:
                    wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4").astype("<u4").tobytes()
                for done, size, sequence, offset in parts:
                    at.append(i)
                    own = crc if len(parts) == 1 else zlib.crc32(wide[4 * done : 4 * (done + size)])
                    out.append((start + done, size, own, total, sequence, offset))
            columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
