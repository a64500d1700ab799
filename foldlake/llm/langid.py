"""Language of words in code-switched text by a linear-chain conditional random field.

Each word is a state, its language. Emissions come from affixes, character n-grams and a lexicon of
frequent words; transitions between languages are learned with them, on sequences that are put
together from pieces of labelled texts in several languages. Forward-backward gives each word's
marginals; `segments` lists runs of words of one language, `predict` sums the marginals to the
language of the whole text.

The model is fitted on the driver on at most `per_lang` labelled texts of each language, and of each
at most `chars` characters (a bounded sample; both are parameters). Prediction reads whole texts.
Words repeat, so a worker keeps a bounded table of their emissions; forward-backward runs over many
texts in step.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text where
there is nothing to learn from; words without letters take the languages of their neighbours and
don't count; equal texts get equal results; ties go to the language first in the alphabet; an empty
table gives an empty result. A null doc_id is held out from learning. doc_id, text and lang are read,
the last for learning alone.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

PER_LANG = 200
CHARS = 4000
UNKNOWN = "und"
#: Words whose emissions a worker keeps.
KNOWN_WORDS = 400_000


@dataclasses.dataclass
class Model:
    langs: list[str]
    index: dict[str, int]
    weights: np.ndarray  # a row for each feature
    transitions: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of the languages of words (as `core` gives them), a row for each."""
        flat: list[int] = []
        sizes = []
        get, unknown = self.index.get, itertools.repeat(len(self.index))
        for word in words:
            before = len(flat)
            flat.extend(map(get, features(word), unknown))
            sizes.append(len(flat) - before)
        weights = np.concatenate([self.weights, np.zeros((1, len(self.langs)), np.float32)])
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(weights[np.array(flat, np.int64)], starts, axis=0) if words else weights[:0]


def core(token: str) -> str:
    """A token in lower case without what isn't a letter."""
    word = token.lower()
    return word if word.isalpha() else "".join([c for c in word if c.isalpha()])


def features(word: str) -> list[str]:
    """The word itself, its affixes and its n-grams with the edges marked. Shorter affixes are among
    the n-grams."""
    edged = f"^{word}$"
    n = len(edged)
    out = [f"={word}", f"<{word[:3]}", f">{word[-3:]}", f"+{word[-4:]}"]
    out += [edged[i : i + 2] for i in range(n - 1)]
    out += [edged[i : i + 3] for i in range(n - 2)]
    return out


def _forward_backward(emit: np.ndarray, move: np.ndarray, lengths: np.ndarray, expected: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word, and the expected moves (zeros where they aren't asked for); emit and move are exponentials. Sequences stand
    one after the other in emit, longest first, and go in step."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    alpha = np.empty_like(emit)
    active = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
    now = emit[starts[: active[0]]] if len(active) else emit[:0]
    for t, n in enumerate(active.tolist()):
        if t:
            now = (now[:n] @ move) * emit[starts[:n] + t]
        now = now / now.sum(axis=1, keepdims=True)
        alpha[starts[:n] + t] = now
    moves = np.zeros_like(move)
    back = np.ones((len(lengths), emit.shape[1]), emit.dtype)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        more = int(active[t + 1]) if t + 1 < len(active) else 0
        if more:
            at = starts[:more] + t
            right = emit[at + 1] * back[:more]
            pair = right @ move.T
            if expected:
                scale = 1 / (alpha[at] * pair).sum(axis=1, keepdims=True)
                moves += (alpha[at] * scale).T @ right * move
            back[:more] = pair / pair.sum(axis=1, keepdims=True)
        at = starts[:n] + t
        if more < n:
            back[more:n] = 1
        gamma = alpha[at] * back[:n]
        # alpha of this place isn't needed any more
        alpha[at] = gamma / gamma.sum(axis=1, keepdims=True)
    return alpha, moves


def fit(texts: list[tuple[str, str]], seed: int = 0, sequences: int = 4000, epochs: int = 4) -> Model | None:
    """texts: (text, language)."""
    rng = np.random.default_rng(seed)
    by_lang: dict[str, list[list[str]]] = {}
    for text, lang in sorted(texts, key=lambda x: (x[1], x[0])):
        words = [w for w in map(core, text.split()) if w]
        if words:
            by_lang.setdefault(lang, []).append(words)
    langs = sorted(by_lang)
    if not langs:
        return None
    runs: list[list[tuple[str, int]]] = []
    for _ in range(sequences):  # texts as they are, and pieces of several languages in a row
        run: list[tuple[str, int]] = []
        for _ in range(int(rng.integers(1, 6))):
            k = int(rng.integers(len(langs)))
            words = by_lang[langs[k]][int(rng.integers(len(by_lang[langs[k]])))]
            size = int(rng.integers(3, 25))
            a = int(rng.integers(max(1, len(words) - size + 1)))
            run += [(w, k) for w in words[a : a + size]]
        runs.append(run)
    counts = Counter(f for run in runs for w, _ in run for f in features(w))
    index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= (3 if f[0] == "=" else 2)))}
    rows: dict[str, np.ndarray] = {}
    for run in runs:
        for w, _ in run:
            if w not in rows:
                rows[w] = np.array([index[f] for f in features(w) if f in index], np.int64)
    size = len(langs)
    weights, transitions = np.zeros((len(index), size)), np.zeros((size, size))
    sums = [np.zeros_like(weights), np.zeros_like(transitions)]
    rate = 0.3
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        for i in range(0, len(order), 64):
            batch = sorted((runs[k] for k in order[i : i + 64]), key=len, reverse=True)
            lengths = np.array([len(r) for r in batch])
            at = [rows[w] for r in batch for w, _ in r]
            truth = np.array([k for r in batch for _, k in r])
            word = np.repeat(np.arange(len(at)), [len(x) for x in at])
            flat = np.concatenate(at)
            score = np.zeros((len(at), size))
            for c in range(size):
                score[:, c] = np.bincount(word, weights[flat, c], len(at))
            emit = np.exp(score - score.max(axis=1, keepdims=True))
            gamma, moves = _forward_backward(emit, np.exp(transitions), lengths)
            gamma[np.arange(len(truth)), truth] -= 1
            first = np.cumsum(lengths) - lengths
            follow = np.ones(len(truth), bool)
            follow[first] = False
            np.add.at(moves, (truth[:-1][follow[1:]], truth[1:][follow[1:]]), -1)
            # AdaGrad on the negative likelihood, with a little decay
            for c in range(size):
                grad = np.bincount(flat, gamma[word, c], len(index)) + 1e-3 * weights[:, c]
                sums[0][:, c] += grad * grad
                weights[:, c] -= rate * grad / np.sqrt(sums[0][:, c] + 1e-6)
            sums[1] += moves * moves
            transitions -= rate * moves / np.sqrt(sums[1] + 1e-6)
    return Model(langs, index, weights.astype(np.float32), transitions.astype(np.float32))


class Labeller:
    """A model with a table of the words it has met."""

    def __init__(self, model: Model, words: int = KNOWN_WORDS):
        self.model, self.limit = model, words
        self.move = np.exp(model.transitions)
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}  # of tokens
        self.cores: dict[str, int] = {"": 0}  # and of what features are made of
        self.table = np.ones((1, len(self.model.langs)), np.float32)  # row 0: no letters

    def _learn(self, tokens: set[str]) -> None:
        fresh: dict[str, int] = {}
        for token in tokens:
            word = core(token)
            row = self.cores.get(word)
            if row is None:
                row = fresh.setdefault(word, len(self.table) + len(fresh))
            self.rows[token] = row
        self.cores |= fresh
        score = self.model.scores(list(fresh))
        if fresh:
            self.table = np.concatenate([self.table, np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -60))])

    def marginals(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text: the marginals of its words (split at white space) and which have letters."""
        if len(self.rows) > self.limit:
            self._clear()
        known, found = self.rows, []
        for i in range(0, len(texts), 64):
            part = [t.split() if t else [] for t in texts[i : i + 64]]
            self._learn({w for words in part for w in words if w not in known})
            found += [np.array([known[w] for w in words], np.int32) for words in part]
        order = sorted(range(len(found)), key=lambda i: -len(found[i]))
        order = [i for i in order if len(found[i])]
        out = [(np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, bool))] * len(texts)
        if order:
            lengths = np.array([len(found[i]) for i in order])
            rows = np.concatenate([found[i] for i in order])
            gamma, _ = _forward_backward(self.table[rows], self.move, lengths, False)
            ends = np.cumsum(lengths)
            for i, a, b in zip(order, (ends - lengths).tolist(), ends.tolist(), strict=True):
                out[i] = gamma[a:b], rows[a:b] > 0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for gamma, letters in self.marginals(texts):
            if not letters.any():
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = gamma[letters].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(min(1.0, total[best] / total.sum())))
        return langs, scores


def held_out(doc_id: Column) -> Column:
    """Rows of which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, per_lang: int = PER_LANG, chars: int = CHARS) -> list[tuple[str, str]]:
    """At most per_lang labelled texts of each language, at most chars characters of each, chosen by a
    hash of doc_id and text."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    key = F.xxhash64("doc_id", "text")
    # how many different ones, as rows that repeat are drawn all or none
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(key).alias("n")).collect()}
    if not counts:
        return []
    # thinned first, so that no language's rows meet in one place
    table = F.broadcast(docs.sparkSession.createDataFrame([(k, min(1.0, 4.0 * per_lang / n)) for k, n in counts.items()], "l string, share double"))
    draw = F.pmod(key, F.lit(1 << 30)).cast("double") / (1 << 30)
    rows = rows.select("lang", F.substring("text", 1, chars).alias("text"), draw.alias("draw")).join(table, F.col("lang") == F.col("l"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    rows = rows.where("draw < share").withColumn("rank", rank).where(F.col("rank") <= per_lang)
    return [(r.text, r.lang) for r in rows.select("text", "lang").collect()]


_labellers: dict[str, Labeller] = {}


def predict(docs: DataFrame, per_lang: int = PER_LANG, chars: int = CHARS, seed: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learned from the labelled rows that aren't held
    out."""
    return apply(docs, fit(sample(docs, per_lang, chars), seed))


def _own(name: str, model: Model) -> Labeller:
    if name not in _labellers:
        _labellers.clear()
        _labellers[name] = Labeller(model)
    return _labellers[name]


def apply(docs: DataFrame, model: Model | None) -> DataFrame:
    import uuid

    spark = docs.sparkSession
    common.ship(spark)
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 10_000, 24 << 20):
            texts = batch.column("text").to_pylist()
            if shared.value is None:
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            else:
                langs, scores = _own(name, shared.value).predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def segments(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, first_word, end_word (exclusive), score: runs of words of one language."""
    import uuid

    spark = docs.sparkSession
    common.ship(spark)
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1000, 4 << 20):
            own = _own(name, shared.value)
            at, out = [], []
            for i, (gamma, letters) in enumerate(own.marginals(batch.column("text").to_pylist())):
                if not letters.any():
                    continue
                best = gamma.argmax(axis=1)
                cuts = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    at.append(i)
                    out.append((own.model.langs[best[a]], a, b, float(gamma[a:b, best[a]].mean())))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], ["doc_id", "lang", "first_word", "end_word", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang string, first_word long, end_word long, score double")
