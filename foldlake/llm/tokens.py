"""Token ids by the `tokenizers` library, for a batch of texts at once.

A byte-level BPE of the GPT-2 kind never joins what stands before a space with that space or what
follows it, as long as the character before the space is no white space itself. Neither does it join
the ends of two lines, or of two lines with one empty line between them. So Arrow cuts a batch of
texts at single spaces and line ends and finds its distinct pieces; only those are looked up in a
bounded table, new ones are cut by the pattern that byte-level tokenizers share, and the library's
model gives their ids; numpy lays the ids out again. A text to which this does not apply (longer runs
of white space, white space other than these two, the content of an added token, other kinds of
tokenizer) is given to the library whole. The ids are the library's in both cases, with its default
for added tokens: their content in a text gives their id.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Pieces that a worker's table holds about.
CACHE_ENTRIES = 600_000

#: Rows and bytes of text that are encoded at once.
ROWS, CHARS = 2500, 8 << 20

# How byte-level tokenizers cut a text, and the characters that stand for its
# bytes, and the bytes that UTF-8 never has.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b for b in PLAIN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PLAIN)}
NEVER = [0xC0, 0xC1, *range(0xF5, 0x100)]

#: What may follow the letters of a word; the word is then looked up without it.
MARKS = ".,;:!?#*$%&|<>()"
#: Words that are given to the library's model in one call.
JOINED = 32
#: Stands before the first piece of a line; a text that has it is encoded whole.
FIRST = "\0"


def laid_out(parts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts that `at` names, on end, and where each ends; parts has all of them on end, with
    their sizes."""
    own = sizes[at]
    ends = np.cumsum(own)
    shift = (np.cumsum(sizes) - sizes)[at] - ends + own
    return parts[np.repeat(shift, own) + np.arange(ends[-1] if len(ends) else 0)], ends


class Pieces:
    """Ids by piece. A full half of the table becomes the older half; an older entry that is asked
    for again comes back."""

    def __init__(self, tokenizer: Tokenizer, kind: np.dtype, merged: set[str], line: list[int], limit: int):
        self.model, self.kind, self.limit = tokenizer.model.tokenize, kind, limit // 2
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.fixed = {FIRST: b"", "\n": np.array(line, kind).tobytes()}
        self.new |= self.fixed
        # a byte that no text in UTF-8 has, and that no merge touches, keeps words apart in one call
        apart = next((chr(BYTES[b]) for b in NEVER if chr(BYTES[b]) not in merged and tokenizer.token_to_id(chr(BYTES[b])) is not None), None)
        self.apart = tokenizer.token_to_id(apart) if apart else None
        self.mapped = BYTES | {10: apart}

    def _spelled(self, words: list[str]) -> list[bytes]:
        """The ids of words that the pattern doesn't cut."""
        if self.apart is None:
            return [np.array([x.id for x in self.model(w.encode().decode("latin-1").translate(BYTES))], self.kind).tobytes() for w in words]
        found: list[int] = []
        for i in range(0, len(words), JOINED):
            found += [x.id for x in self.model("\n".join([*words[i : i + JOINED], ""]).encode().decode("latin-1").translate(self.mapped))]
        ids = np.array(found, self.kind)
        stops = np.flatnonzero(ids == self.apart) * self.kind.itemsize
        data, at, out = ids.tobytes(), 0, []
        for stop in stops.tolist():
            out.append(data[at:stop])
            at = stop + self.kind.itemsize
        return out

    def _made(self, words: list[str]) -> list[bytes]:
        """The ids of pieces with what leads them."""
        units, at, tails, cut = [], [], [], []
        for i, w in enumerate(words):
            core = w.rstrip(MARKS)
            if core[core[:1] == " " :].isalpha():
                units.append(core)
                at.append(i)
                tails.append(w[len(core) :])
            else:
                cut.append(i)
        out: list[bytes] = [b""] * len(words)
        marks = [*set(tails).difference(self.marks)]
        if len(self.marks) + len(marks) > 10_000:
            self.marks, marks = {"": b""}, [*set(tails).difference([""])]
        self.marks.update(zip(marks, self._spelled(marks), strict=True))
        for i, x, tail in zip(at, self._spelled(units), tails, strict=True):
            out[i] = x + self.marks[tail]
        for i in cut:
            out[i] = b"".join(self._spelled(CUT.findall(words[i])))
        return out

    def of(self, names: list[str]) -> list[bytes]:
        """The ids of pieces."""
        out = list(map(self.new.get, names))
        missing = [i for i, x in enumerate(out) if x is None]
        older = list(map(self.old.get, [names[i] for i in missing]))
        asked = [i for i, x in zip(missing, older, strict=True) if x is None]
        made = iter(self._made([names[i][1:] if names[i][0] == FIRST else " " + names[i] for i in asked]))
        for i, x in zip(missing, older, strict=True):
            out[i] = x = next(made) if x is None else x
            if len(p := names[i]) < 64:
                self.new[p] = x
        if len(self.new) > self.limit:
            self.old, self.new = self.new, dict(self.fixed)
        return out


class PieceEncoder:
    def __init__(self, spec: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(spec)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        parts = json.loads(spec)
        merges = parts["model"].get("merges") or []
        merged = {c for m in merges for c in (m if isinstance(m, str) else "".join(m))}
        pre = parts.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cuts = bool(plain and not parts.get("normalizer") and len(line) == 1)
        self.pieces = Pieces(self.tokenizer, self.kind, merged, line, cache_entries)
        self.whole = [FIRST, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]

    def _cut(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, lengths by text, and which texts must be encoded whole."""
        lines = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), pc.replace_substring(texts, "\n", f" \n {FIRST}"), pa.scalar("", pa.large_string()))
        cut = pc.split_pattern(lines, " ")
        coded = cut.flatten().dictionary_encode()
        at, bounds = coded.indices.to_numpy(), np.asarray(cut.offsets, np.int64) - cut.offsets[0].as_py()
        parts, sizes, bad, empty = self._distinct(coded.dictionary)
        wrong = bad[at]
        if empty >= 0:
            # two empty lines on end: their line ends are one run
            empties = at == empty
            wrong[:-2] |= empties[:-2] & empties[2:]
        wrong = np.concatenate([[0], np.cumsum(wrong)])
        if end_id is not None:
            at = np.insert(at, bounds[1:], len(sizes))
            parts, sizes = np.append(parts, self.kind.type(end_id)), np.append(sizes, 1)
        ids, ends = laid_out(parts, sizes, at)
        last = bounds[1:] + np.arange(1, len(texts) + 1) if end_id is not None else bounds[1:]
        stops = np.concatenate([[0], ends])[last]
        return ids, np.diff(stops, prepend=0), wrong[bounds[1:]] > wrong[bounds[:-1]]

    def _distinct(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The ids of distinct pieces on end, their sizes, which of them can't be told from their
        neighbours, and the place of an empty line (-1: none)."""
        body = pc.utf8_ltrim(names, characters=FIRST)
        size = pc.binary_length(pc.utf8_trim_whitespace(body)).to_numpy()
        bad = (size == 0) | (size < pc.binary_length(body).to_numpy())
        line, empty = pc.index(names, "\n").as_py(), pc.index(names, FIRST).as_py()
        bad[[i for i in (line, empty) if i >= 0]] = False
        found = self.pieces.of(pc.if_else(pa.array(bad), FIRST, names).to_numpy(zero_copy_only=False).tolist())
        return np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize, bad, empty

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) on end, each text's followed by end_id if there is one,
        and the place where each begins, with the end of the last behind them."""
        if end_id is not None and end_id >= 1 << (8 * self.kind.itemsize):
            raise ValueError("the end id doesn't fit the ids")
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.array([], self.kind), np.zeros(1, np.int64)
        whole = np.full(len(texts), not self.cuts)
        if self.cuts:
            for content in self.whole:
                whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        ids, lengths, more = self._cut(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts, end_id)
        whole |= more
        if whole.any():
            rows = np.flatnonzero(whole)
            end = [] if end_id is None else [end_id]
            given = self.tokenizer.encode_batch_fast(texts.take(pa.array(rows)).to_pylist(), add_special_tokens=False)
            stops = np.cumsum(lengths)
            parts, at = [], 0
            for i, x in zip(rows.tolist(), given, strict=True):
                own = np.array([*x.ids, *end], self.kind)
                parts += [ids[at : stops[i] - lengths[i]], own]
                at = stops[i]
                lengths[i] = len(own)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, np.concatenate([[0], np.cumsum(lengths)])


_encoders: dict[str, PieceEncoder] = {}


def encoder(spec: str) -> PieceEncoder:
    """This worker's encoder for the tokenizer `spec` (the JSON text of its file)."""
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = PieceEncoder(spec)
    return _encoders[spec]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
