"""Seeded synthetic bytes: fixtures that are the same in every run and on every machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MASK = (1 << 64) - 1


class SplitMix64:
    """A generator of 64-bit numbers (Steele, Lea and Flood 2014)."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
        return z ^ z >> 31

    def bytes(self, n: int) -> bytes:
        return b"".join(self.next().to_bytes(8, "little") for _ in range((n + 7) // 8))[:n]

    def below(self, n: int) -> int:
        return self.next() % n


def text(seed: int, size: int, words: int = 4000) -> bytes:
    """Mostly words of hexadecimal letters, some runs of random bytes between them."""
    rng = SplitMix64(seed)
    known = [f"{rng.next():x}"[: 3 + rng.below(8)].encode() + b" " for _ in range(words)]
    out, held = [], 0
    while held < size:
        part = known[rng.below(words)] if rng.below(10) < 7 else rng.bytes(16 + rng.below(241))
        out.append(part)
        held += len(part)
    return b"".join(out)[:size]


def tree(spark: SparkSession, files: int, average: int, seed: int) -> DataFrame:
    """name, data of a tree of small files, each from a seed of its own."""
    from foldlake.sources.shipping import ship

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = [], []
            for i in batch.column("id").to_pylist():
                rng = SplitMix64(seed + i)
                size = average // 4 + rng.below(max(1, average * 3 // 2))
                names.append(f"d{i % 64:02d}/{i:05d}.txt")
                data.append(text(seed + i, size, 200))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], ["name", "data"])

    return spark.range(files).mapInArrow(run, "name string, data binary")
