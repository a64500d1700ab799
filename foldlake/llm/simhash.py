"""SimHash near-duplicates: exact tiled comparison of fingerprints, then connected components.

`fingerprints` makes a 64-bit SimHash of each text. `links` compares distinct fingerprints tile by
tile with numpy's exclusive-or and bit counts: a tile holds fingerprints of one population count (of
the whole and of the upper half), and tile pairs whose counts differ by more than the radius are
never formed, since each differing bit changes a count by one. Inside a pair, blocks of rows sorted
by the counts of their four quarters are passed over in the same way. A pair of tiles yields a
spanning forest of its links, never all of them, so that large groups of near copies stay linear.
`components` joins the forests by alternating large-star and small-star rounds, each of which ends
in a table in the shared folder.

Defined results: a null or empty text (no word) has fingerprint zero and is linked like any other;
a text shorter than a shingle is hashed as one shingle; equal rows stay separate rows with the same
component; a null doc_id never names a component that has another doc_id; `keep_one` keeps one row of
each component, whatever its doc_id, so unlike texts under one doc_id or none all stay; an empty
table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import common

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints that a tile holds about, at least and at most; two tiles meet in a task. In between, a tile
#: is as large as the densest cell: a fingerprint is then copied once for each cell that its own one meets
#: (41 at most), however many fingerprints there are. A tile of the largest size is 8 MB.
TILE = 8192
LARGEST_TILE = 1 << 20
#: Rows of a block inside a tile.
BLOCK = 256


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `shingle` lower-cased words, repeats included."""
    words = text.encode().lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 17):
        part = np.ascontiguousarray(hashes[i : i + (1 << 17)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), digest (of the text) of each row."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2000, 32 << 20):
            fps = np.fromiter((simhash(shingle_hashes(t.as_py(), shingle, seed)) for t in batch.column("text")), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("digest")], ["doc_id", "fp", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, f"doc_id {kind}, fp long, digest long")


def quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of tile a, or between tiles a and b:
    each linked fingerprint with the smallest position of its tree."""

    def ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = quarters(x)
        at = np.lexsort(q.T[::-1])
        x, q = x[at], q[at]
        cuts = np.arange(0, len(x), block)
        return x, np.minimum.reduceat(q, cuts, axis=0), np.maximum.reduceat(q, cuts, axis=0)

    own = b is None
    a, a_low, a_high = ordered(a)
    b, b_low, b_high = (a, a_low, a_high) if own else ordered(b)
    nodes = a if own else np.concatenate([a, b])
    shift = 0 if own else len(a)
    label = np.arange(len(nodes))
    sizes = np.minimum(block, len(b) - np.arange(0, len(b), block))
    for k in range(len(a_low)):
        apart = np.maximum(0, np.maximum(a_low[k] - b_high, b_low - a_high[k])).sum(axis=1)
        near = apart <= radius
        if own:
            near[:k] = False
        if not near.any():
            continue
        rows = np.flatnonzero(np.repeat(near, sizes))
        for part in np.array_split(rows, max(1, len(rows) // 4096)):
            i, j = np.nonzero(np.bitwise_count(a[k * block : (k + 1) * block, None] ^ b[part]) <= radius)
            i, j = i + k * block, part[j] + shift
            while True:  # the links that still cross trees join them; labels only fall
                x, y = label[i], label[j]
                cross = x != y
                if not cross.any():
                    break
                i, j, x, y = i[cross], j[cross], x[cross], y[cross]
                low = np.minimum(x, y)
                np.minimum.at(label, x, low)
                np.minimum.at(label, y, low)
                while not np.array_equal(up := label[label], label):
                    label = up
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """Forests of the links between the fingerprints (column fp, no two equal): columns a > b."""
    spark = distinct.sparkSession
    common.ship(spark)
    total, high = F.bit_count("fp"), F.bit_count(F.shiftrightunsigned("fp", 32))
    cells = distinct.select("fp", total.alias("total"), high.alias("high"))
    # at most 33 x 33 counts: how many tiles the fingerprints of each cell make
    sizes = {(r.total, r.high): r.n for r in cells.groupBy("total", "high").agg(F.count("*").alias("n")).collect()}
    tile = tile or min(max(TILE, *sizes.values()), LARGEST_TILE) if sizes else TILE
    parts = {cell: -(-n // tile) for cell, n in sizes.items()}
    code = {cell: k for k, cell in enumerate(sorted(parts))}
    pairs = []  # cell, its tiles, a cell that it meets, that one's tiles, whether it comes first
    for (t, h), n in parts.items():
        for (u, g), m in parts.items():
            if abs(h - g) + abs((t - h) - (u - g)) <= radius:
                pairs.append((t, h, n, code[t, h], m, code[u, g]))
    if not pairs:
        return spark.createDataFrame([], "a long, b long")
    met = F.broadcast(spark.createDataFrame(pairs, "total int, high int, n int, own int, m int, other int"))
    # a tile: a cell and a share of its fingerprints; a task: an unordered pair of tiles that may hold links
    share = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    tiles = (
        cells.join(met, ["total", "high"])
        .select("fp", "own", "other", share.alias("share"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other_share"))
        .select("fp", F.struct("own", "share").alias("x"), F.struct(F.col("other").alias("own"), F.col("other_share").alias("share")).alias("y"))
        .select("fp", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), (F.col("x") <= F.col("y")).alias("first"))
        .select("fp", "first", F.col("lo.own").alias("c0"), F.col("lo.share").alias("s0"), F.col("hi.own").alias("c1"), F.col("hi.share").alias("s1"))
    )

    def compare(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        first = table.column("first").to_numpy()
        own = table.column("c0")[0] == table.column("c1")[0] and table.column("s0")[0] == table.column("s1")[0]
        a, b = (fps, None) if own else (fps[first], fps[~first])
        x, y = forest(a, b, radius) if len(a) and (own or len(b)) else (fps[:0], fps[:0])
        x, y = x.view(np.int64), y.view(np.int64)
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return tiles.groupBy("c0", "s0", "c1", "s1").applyInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """fp, root for each end of a link: the smallest one that can be reached. Alternating large-star
    and small-star rounds (Kiveris et al. 2014); a round's links are written before the next one."""
    edges = common.written(links.where("a <> b").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        state = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.written(small.union(low).distinct(), "links")


def named(fps: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of fps (doc_id, fp and others) with component_id, root (by roots), and head: whether the row's
    fingerprint and doc_id name its component. distinct has fp and least_id, the smallest doc_id of it."""
    found = distinct.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = found.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull(), "least_id", "fp")).alias("name"))
    found = found.join(names, "root").select("fp", "root", F.col("name.least_id").alias("component_id"), (F.col("name.fp") == F.col("fp")).alias("head"))
    found = common.written(found, "components")
    return fps.join(found, "fp").withColumn("head", F.col("head") & F.col("doc_id").eqNullSafe(F.col("component_id")))


def _rows(docs: DataFrame, radius: int, shingle: int, seed: int, tile: int | None) -> DataFrame:
    fps = common.written(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    return named(fps, distinct, components(links(distinct.select("fp"), radius, tile)))


def cluster(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, tile: int | None = None) -> DataFrame:
    """doc_id, fp, component_id, head (whether the row's fingerprint and doc_id name its component)
    for each row of docs."""
    return _rows(docs, radius, shingle, seed, tile).select("doc_id", "fp", "component_id", "head")


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def heads_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each component of rows (doc_id, digest, root, head) one row of docs: a head, and of heads
    with several texts the one with the smallest digest."""
    own = common.unused(docs.columns, "__head")
    heads = rows.where("head").groupBy("root").agg(F.min(F.struct("digest", "doc_id")).alias("x")).select("x.*")
    # a null doc_id as a value and a flag, and the text's digest: the same on both sides of the join and
    # in the window, so that texts are dealt out once
    key = [f"{own}_id", f"{own}_null", f"{own}_digest"]
    keyed = lambda df, digest: df.withColumns({key[0]: F.coalesce(F.col("doc_id"), F.lit(0)), key[1]: F.col("doc_id").isNull(), key[2]: digest})
    found = keyed(docs, F.xxhash64("text")).join(keyed(heads, F.col("digest")).select(*key), key, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("text"))
    return found.withColumn(own, rank).where(F.col(own) == 1).drop(own, *key)


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, tile: int | None = None) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row that names it."""
    return heads_of(docs, _rows(docs, radius, shingle, seed, tile))
