"""Quality rules on repetition: suffix arrays over words, and the maximal repeats in their
longest-common-prefix intervals.

The texts of a batch are one sequence of word numbers, each text with an end mark of its own, and
are sorted together by prefix doubling, where only suffixes that still share a prefix with another of
their text are sorted again. The ranks of each round give the longest common prefixes of neighbours
by binary descent. The union of the spans of all repeats of `min_repeat` words or more, and the
longest repeat, follow from the larger of a suffix's two neighbouring prefixes; `maximal_repeats`
lists the intervals themselves.

A text passes the method if repeats of `min_repeat` words or more cover at most `max_covered` of its
words and no repeat is longer than `max_longest` words. The base rules stand before it.

Defined results: a null text has no words and fails the base rule on length, as an empty one does;
equal rows get equal results; an empty table gives an empty result. A very long text makes a batch of
its own. `rules` reads doc_id and text alone; `keep` hands all columns through as they are.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclasses.dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_words: int = 50  # percent of the words in repeated windows
    window: int = 3
    min_repeat: int = 8
    max_covered: float = 0.4
    max_longest: int = 100


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted key: for each place the first place of its group, and whether the group has more."""
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    return first, ~(fresh & np.concatenate([fresh[1:], [True]])) if len(key) else fresh


class Suffixes:
    """Suffix arrays of several sequences at once. ids: item numbers, one sequence after the other;
    lengths: their lengths. levels[k] ranks all places so that two are equal if and only if they
    are of one sequence and share 2**k items: 4 bytes for each place and level."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        count, words = len(lengths), int(ids.max(initial=0)) + 1
        self.n = n = len(ids) + count
        self.ends = np.cumsum(lengths + 1) - 1  # of each sequence the place of its end mark, unlike all items
        self.starts = self.ends - lengths
        doc = np.repeat(np.arange(count), lengths + 1)
        key = np.full(n, words, np.int64)
        items = np.ones(n, bool)
        items[self.ends] = False
        key[items] = ids
        key += doc * np.int64(words + 1)
        self.order = np.argsort(key, kind="stable")
        first, more = _groups(key[self.order])
        rank = np.empty(n, np.int64)
        rank[self.order] = first
        self.levels, places, step = [rank.astype(np.int32)], self.order[more], 1
        while len(places):
            key = rank[places] * np.int64(n) + rank[places + step]
            by = np.argsort(key, kind="stable")
            key, places = key[by], places[by]
            old = rank[places]
            slot = old + np.arange(len(places)) - _groups(old)[0]
            self.order[slot] = places
            first, more = _groups(key)
            rank[places] = slot[first]
            self.levels.append(rank.astype(np.int32))
            places = places[more]
            step *= 2

    def shared(self, k: int) -> np.ndarray:
        """The places that share 2**k items with another of their sequence."""
        return self.order[_groups(self.levels[k][self.order])[1]]

    def neighbours(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places a, b next to each other in the sorted order, and the length of their longest common
        prefix, where it is `least` (1 or more) or more."""
        k = least.bit_length() - 1
        if k >= len(self.levels):
            none = np.zeros(0, np.int64)
            return none, none, none
        ranks = self.levels[k][self.order]
        at = np.flatnonzero(ranks[1:] == ranks[:-1])
        a, b = self.order[at], self.order[at + 1]
        length = np.zeros(len(at), np.int64)
        for k in reversed(range(len(self.levels))):
            length += (self.levels[k][a + length] == self.levels[k][b + length]).astype(np.int64) << k
        enough = length >= least
        return a[enough], b[enough], length[enough]

    def windows(self, size: int) -> np.ndarray:
        """Places whose next `size` items stand twice or more in their sequence."""
        k = size.bit_length() - 1
        if k >= len(self.levels):
            return np.zeros(0, np.int64)
        places = self.shared(k)
        key = self.levels[k][places] * np.int64(self.n) + self.levels[k][places + size - (1 << k)]
        by = np.argsort(key, kind="stable")
        return places[by][_groups(key[by])[1]]

    def covered(self, places: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """Of each sequence, how many items lie in the union of the spans."""
        change = np.zeros(self.n + 1, np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + lengths, -1)
        under = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
        return under[self.ends] - under[self.starts]


def maximal_repeats(ids: list[int] | np.ndarray, least: int = 1) -> list[tuple[int, list[int]]]:
    """(length, places) of each repeat of `least` items or more that can't be made longer to either
    side at all of its places: the intervals of equal longest common prefix, left-maximal ones."""
    ids = np.asarray(ids, np.int64)
    array = Suffixes(ids, np.array([len(ids)]))
    a, b, length = array.neighbours(max(1, least))
    slot = np.empty(array.n, np.int64)
    slot[array.order] = np.arange(array.n)
    lcp = np.zeros(array.n + 1, np.int64)
    lcp[slot[b]] = length
    found, stack = [], [(0, 0)]  # prefix length, first slot
    for i in range(1, array.n + 1):
        first = i - 1
        while lcp[i] < stack[-1][0]:
            size, first = stack.pop()
            places = sorted(array.order[first:i].tolist())
            if len({int(ids[p - 1]) if p else -1 for p in places}) > 1:
                found.append((size, places))
        if lcp[i] > stack[-1][0]:
            stack.append((int(lcp[i]), first))
    return sorted(found, key=lambda x: (-x[0], x[1]))


def measure(texts: list[str | None], limits: Limits) -> dict[str, np.ndarray]:
    """The figures and verdicts of each text."""
    numbers: dict[bytes, int] = {}
    ids: list[int] = []
    lengths, chars, symbols, lines = [], [], [], []
    for text in texts:
        text = text or ""
        words = text.encode().split()  # at the six ASCII white spaces, no others
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        lengths.append(len(words))
        chars.append(len(text) - sum(map(text.count, SPACES)))
        symbols.append(sum(map(text.count, SYMBOLS)))
        with_word = [x for x in text.split("\n") if x.strip(SPACES)]
        lines.append(len(with_word) - len(set(with_word)))
    n_words = np.array(lengths, np.int64)
    array = Suffixes(np.array(ids, np.int64), n_words)
    repeat_words = array.covered(array.windows(limits.window), limits.window)
    a, b, length = array.neighbours(limits.min_repeat)
    reach = np.zeros(array.n, np.int64)
    np.maximum.at(reach, a, length)
    np.maximum.at(reach, b, length)
    places = np.flatnonzero(reach)
    covered = array.covered(places, reach[places])
    longest = np.maximum.reduceat(reach, array.starts) if len(texts) else reach
    failed = (n_words < limits.min_words) | (100 * repeat_words > limits.max_repeat_words * n_words)
    repeats = (covered > limits.max_covered * n_words) | (longest > limits.max_longest)
    return {
        "n_words": n_words,
        "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": ~(failed | repeats),
        "covered_words": covered,
        "longest_repeat": longest,
    }


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"
#: Rows and bytes of text whose suffixes are sorted together.
ROWS, CHARS = 1000, 2 << 20


def rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """doc_id and the figures of each row."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", ROWS, CHARS):
            found = measure(batch.column("text").to_pylist(), limits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def keep(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The rows of docs that pass, with all their columns."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", ROWS, CHARS):
            yield batch.filter(pa.array(measure(batch.column("text").to_pylist(), limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
