"""Near copies by SimHash, confirmed by likeness: texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more, then connected components.

`signatures` makes SimHashes of each text's set of shingles as `simhash` does, `WORDS` of 64 bits, the first
by the shingles' XXH64 itself, the others by that hash mixed again. `candidates` compares all fingerprints tile
by tile with exclusive-or and bit counts: a tile holds sets of one class of sizes, and only classes whose sizes
allow the similarity meet. A pair is a candidate where its first words differ in `RADIUS` bits or fewer and all its
words in `WIDE` or fewer: a pair at 0.8 differs in 9.7 of 64 bits and 78 of 512, and is missed with a probability
of about one in a hundred thousand; more alike ones with a lower one. A pair of tiles yields a spanning forest of its
candidates, so that large groups stay linear. No link leaves a component of candidates, so `confirmed`
compares the sets of its members, exactly, and yields a spanning forest of the pairs at 0.8 or more.

Defined results: texts with equal sets (null and empty ones too, whose set is empty) are copies; a text
shorter than a shingle is one shingle; a null doc_id is as in `simhash`. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common, simhash

SHINGLE = 5
#: Links have a similarity of LIKE[0] / LIKE[1] at least.
LIKE = (4, 5)
WORDS = 8
#: Bits in which candidates differ at most, in the first word and in all.
RADIUS, WIDE = 24, 114
#: Sizes of a class differ by less than this factor, so that sets of which one is LIKE times the other lie in
#: one class or in neighbours.
CLASS = 1.26
#: Fingerprints that a tile holds about, at most; rows and columns that are compared at once.
TILE, BLOCK = 1 << 18, (64, 4096)
#: Sets of a component, and shingles in them, that a task holds about; two such parts meet in it.
SETS, SHINGLES = 1024, 1 << 21

# fixed values of splitmix64, which mixes a shingle's hash for each further word
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def words(own: np.ndarray) -> np.ndarray:
    """The SimHashes of a set of shingles: the bits that are set in over half of each word's hashes."""
    counts = np.zeros(64 * WORDS, np.int64)
    steps = np.arange(WORDS, dtype=np.uint64) * _STEP
    for i in range(0, len(own), 255):  # as many as a byte counts
        x = own[i : i + 255, None] + steps
        x[:, 1:] = (x[:, 1:] ^ x[:, 1:] >> np.uint64(30)) * _MIX[0]
        x[:, 1:] = (x[:, 1:] ^ x[:, 1:] >> np.uint64(27)) * _MIX[1]
        x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own), bitorder="little").view(np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, fp (of the set of shingles), size of the set, its words."""
    common.ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2000, 32 << 20):
            fps, sizes, marks = [], [], []
            for t in batch.column("text"):
                own = shingles(t.as_py())
                fps.append(xxhash.xxh64_intdigest(own.tobytes()))
                sizes.append(len(own))
                marks.append(words(own).tobytes())
            columns = [batch.column("doc_id"), batch.column("digest"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "fp", "size", "words"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(run, f"doc_id {kind}, digest long, fp long, size int, words binary")


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels once the links (i, j) have joined their trees; labels only fall."""
    while len(i):
        x, y = label[i], label[j]
        cross = x != y
        i, j, x, y = i[cross], j[cross], x[cross], y[cross]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def may(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return np.minimum(small, large) * LIKE[1] >= np.maximum(small, large) * LIKE[0]


def forest(sizes: np.ndarray, marks: np.ndarray, split: int | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidates among the rows, or between the first `split` rows and the others:
    positions of each one with the least of its tree. Both parts are sorted by size."""
    first = np.ascontiguousarray(marks[:, 0])
    label = np.arange(len(sizes))
    shift = split or 0
    right = sizes[shift:]
    for k in range(0, split or len(sizes), BLOCK[0]):
        rows = slice(k, min(k + BLOCK[0], split or len(sizes)))
        low = np.searchsorted(right, -(-sizes[k] * LIKE[0] // LIKE[1])) if split else k
        high = np.searchsorted(right, sizes[rows.stop - 1] * LIKE[1] // LIKE[0], "right")
        for c in range(shift + low, shift + high, BLOCK[1]):
            part = first[c : min(c + BLOCK[1], shift + high)]
            i, j = np.divmod(np.flatnonzero(np.bitwise_count(first[rows, None] ^ part) <= RADIUS), len(part))
            i, j = i + k, j + c
            for near in (lambda: label[i] != label[j], lambda: may(sizes[i], sizes[j]), lambda: np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64) <= WIDE):
                keep = near()
                i, j = i[keep], j[keep]
            label = joined(label, i, j)
    linked = np.flatnonzero(label != np.arange(len(sizes)))
    return linked, label[linked]


def candidates(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Forests of the candidates among sets (fp, size, words; no two fp equal): columns a > b."""
    spark = distinct.sparkSession
    common.ship(spark)
    rows = distinct.where("size > 0").select("fp", "size", "words", F.floor(F.log("size") / np.log(CLASS).item()).cast("int").alias("own"))
    # a row for each class: the tiles that it makes
    parts = {r.own: -(-r.n // tile) for r in rows.groupBy("own").agg(F.count("*").alias("n")).collect()}
    met = [(own, n, other, parts[other]) for own, n in parts.items() for other in (own - 1, own, own + 1) if other in parts]
    if not met:
        return spark.createDataFrame([], "a long, b long")
    share = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    tiles = (
        rows.join(F.broadcast(spark.createDataFrame(met, "own int, n int, other int, m int")), "own")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("fp", "size", "words", F.struct("own", share.alias("part")).alias("x"), F.struct(F.col("other").alias("own"), "part").alias("y"))
        .select("fp", "size", "words", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), (F.col("x") <= F.col("y")).alias("first"))
        .select("fp", "size", "words", "first", F.col("lo.own").alias("c0"), F.col("lo.part").alias("s0"), F.col("hi.own").alias("c1"), F.col("hi.part").alias("s1"))
    )

    def compare(table: pa.Table) -> pa.Table:
        size, first = table.column("size").to_numpy().astype(np.int64), table.column("first").to_numpy()
        order = np.lexsort([size, ~first])
        fp, split = table.column("fp").to_numpy()[order], int(first.sum())
        marks = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64).reshape(-1, WORDS)[order]
        own = table.column("c0")[0] == table.column("c1")[0] and table.column("s0")[0] == table.column("s1")[0]
        i, j = forest(size[order], marks, None if own else split) if own or 0 < split < len(fp) else ([], [])
        return pa.table({"a": np.maximum(fp[i], fp[j]), "b": np.minimum(fp[i], fp[j])}) if len(i) else pa.table({"a": fp[:0], "b": fp[:0]})

    return tiles.groupBy("c0", "s0", "c1", "s1").applyInArrow(compare, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, root, words and own (its set of shingles) for each row of wanted (fp, root, words, digest of a text that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2000, 8 << 20):
            own = [shingles(t.as_py()).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fp", "root", "words")), pa.array(own, pa.list_(pa.int64()))], ["fp", "root", "words", "own"])

    texts = docs.select("text", F.xxhash64("text").alias("digest")).join(wanted, "digest")
    return texts.dropDuplicates(["fp"]).select("fp", "root", "words", "text").mapInArrow(run, "fp long, root long, words binary, own array<long>")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * LIKE[1] >= (len(x) + len(y) - both) * LIKE[0]


def confirmed(members: DataFrame, sets: int = SETS, total: int = SHINGLES) -> DataFrame:
    """Forests of the links (a > b) among members (fp, root of the component of candidates, words, own). A component
    is compared in parts, two in a task, so that none grows beyond what a task holds."""
    common.ship(members.sparkSession)
    parts = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / sets, F.sum(F.size("own")) / total)).cast("int").alias("parts"))
    share = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = members.join(parts, "root").withColumn("part", share).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("fp", "words", "own", "part", "root", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    key = ["root", "lo", "hi"]

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        _, lo, hi = rows[0][-3:]
        fps, marks, own, part = ([r[c] for r in rows] for c in range(4))
        size, part, marks = np.array([len(s) for s in own]), np.array(part), np.frombuffer(b"".join(marks), np.uint64).reshape(-1, WORDS)
        label, found = np.arange(len(rows)), []
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        for k, i in enumerate(left.tolist()):
            rest = right[k + 1 :] if lo == hi else right
            rest = rest[(label[rest] != label[i]) & may(size[rest], size[i])]
            rest = rest[np.bitwise_count(marks[rest] ^ marks[i]).sum(axis=1, dtype=np.int64) <= WIDE]
            for j in rest.tolist():
                if label[i] != label[j] and alike(own[i], own[j]):
                    label[label == label[j]] = label[i]
                    found.append((max(fps[i], fps[j]), min(fps[i], fps[j])))
        return found

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("fp", "words")]
            lists, flags = batch.column("own"), [batch.column(c).to_pylist() for c in ("part", *key)]
            yield from zip(*columns, (x.values.to_numpy() for x in lists), *flags, strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(listed(batches), key=lambda r: r[-3:]):
            if len(held := list(group)) > 1 and (found := compare(held)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def components(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """fp, root for each set of shingles that has a link, of docs and their signatures."""
    distinct = marks.groupBy("fp").agg(F.min("size").alias("size"), F.min("words").alias("words"), F.min("digest").alias("digest"))
    distinct = common.written(distinct, "sets")
    roots = common.written(simhash.components(candidates(distinct)), "candidates")
    roots = roots.union(roots.select("root", "root").distinct())
    members = common.written(sets_of(docs, distinct.select("fp", "words", "digest").join(roots, "fp")), "members")
    return simhash.components(confirmed(members))


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, digest, fp, component_id, root, head for each row of docs, as `simhash.named` has them."""
    marks = common.written(signatures(docs), "signatures")
    distinct = common.written(marks.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    return simhash.named(marks.select("doc_id", "digest", "fp"), distinct, components(docs, marks))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component one row that names it."""
    return simhash.heads_of(docs, cluster(docs))
