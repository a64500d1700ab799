"""Mixing sources to target weights by iterative proportional fitting.

One scan counts words by source, language and topic. A source with at least `source_floor` of all
words is a category of its own, so there are at most 1 / source_floor of them; all others are the one
category `OTHER`, as are languages and topics that the targets don't name. So the cells are bounded
by the targets, whatever the data holds. Sources' targets are levelled: among those that are named, a
share goes by its `source_power`, and what is above `source_cap` then is shared out among the others.
On the driver the cells' words are raked in turn to the marginals until they fit; where they can't
all be met (cells without words), a warning says by how much they are missed. A cell's weight is raked
words over words, and a document is kept with probability weight over largest weight: what is kept
has the target marginals in expectation, without repeating documents. The draw is a hash of doc_id and
text against the probability, so it is the same in every run.

A document's topic is the one of which its text has most evidence: stems of a lexicon that English,
French, German and Spanish share, and marks of tables and records. One pattern finds all evidence in
one pass; with less than one find in `DENSITY` words the topic is `general`, and of equal ones the
first that is listed counts.

Defined results: a null lang or source is `OTHER`; a null or empty text has no words, changes no cell
and is kept with the probability of its cell (1 where the cell has no words); equal rows are drawn
alike; a target for a category without words is dropped, and the others share it in proportion; an
empty table gives an empty result. `sample` hands all columns through as they are.
"""

from __future__ import annotations

import dataclasses
import warnings
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import common

OTHER = "*"
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 200
#: Words for each piece of evidence that a topic needs.
DENSITY = 500

# Stems (from a word's head) and patterns that are evidence of a topic.
STEMS = {
    "law": "licens lizenz licenc copyright court gericht tribunal statut juris legal contract contrat vertrag attorney plaintiff defendant liabil clause klausel",
    "technology": "algorithm algorit software hardware comput password passw token server database datenbank internet programm kernel compil encrypt http api_ api-",
    "science": "hypothes theor physi chem quant molecul atom experiment galax planet evolution species isotop laborator scien",
    "health": "patient medic medizin hospital doctor clinic klinik disease symptom therap diagnos vaccin pharma surg",
    "finance": "bank financ finanz invest credit kredit market markt inflation revenue budget econom dividend equity portfolio",
    "politics": "govern parliament parlament minist president präsident elect senat democra demokra policy politi republi",
    "sport": "football fútbol fußball olymp champion athlet tournament turnier stadi coach goalkeep tennis",
    "culture": "theat museum musée musik music novel roman poet paint orchest opera literat cinema",
}
RECORDS = r" \| |[0-9]{5,}"
GENERAL = "general"
#: How far a marginal may be missed without a warning.
GAP = 1e-6


def _stems(stems: Iterable[str]) -> str:
    """A pattern that finds a stem at the head of a word, its first letter in either case."""
    by_first: dict[str, list[str]] = {}
    for x in stems:
        by_first.setdefault(x[0], []).append(x[1:])
    return "(?:^|[^A-Za-z])(?:" + "|".join(f"[{c.upper()}{c}](?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"


#: The evidence of each topic, and of all.
TOPICS = {name: _stems(stems.split()) for name, stems in STEMS.items()} | {"records": RECORDS}
EVIDENCE = _stems(x for stems in STEMS.values() for x in stems.split()) + "|" + RECORDS


@dataclasses.dataclass(frozen=True)
class Targets:
    """Shares of the words: of languages and topics that are named (None: a category of its own that
    keeps its share), of sources that are named or else those with enough words, levelled."""

    lang: Mapping[str, float]
    topic: Mapping[str, float | None]
    source: Mapping[str, float] | None = None
    source_floor: float = 0.01
    source_power: float = 0.5
    source_cap: float = 0.2
    rounds: int = ROUNDS
    seed: int = 7


#: Languages are levelled a little, records and licence texts kept few, other topics as they are.
DEFAULT = Targets(lang={"en": 0.56, "fr": 0.16, "de": 0.16, "es": 0.12}, topic={GENERAL: None} | dict.fromkeys(STEMS) | {"law": 0.01, "records": 0.02})


def _category(column: str, named: Iterable[str]) -> Column:
    known = sorted(named)
    return F.when(F.col(column).isin(known), F.col(column)).otherwise(F.lit(OTHER)) if known else F.lit(OTHER)


def evidence_counts(evidence: Column) -> Column:
    """How often each topic is among what EVIDENCE found in a text (on end); null if nothing was."""
    return F.when(evidence != "", F.array(*[F.regexp_count(evidence, F.lit(p)) for p in TOPICS.values()]))


def topic(counts: Column, words: Column) -> Column:
    """The topic by evidence_counts()."""
    most = F.array_max(counts)
    enough = (most > 0) & (most * DENSITY >= words)
    return F.when(enough, F.get(F.array(*map(F.lit, TOPICS)), F.array_position(counts, most).cast("int") - 1)).otherwise(GENERAL)


def levelled(shares: Mapping[str, float], targets: Targets) -> dict[str, float]:
    """The targets of sources that have these shares of the words (OTHER: all that aren't named)."""
    if targets.source is not None:
        return dict(targets.source)
    named = {s: v for s, v in shares.items() if s != OTHER}
    whole, powers = sum(named.values()), sum(v**targets.source_power for v in named.values())
    wanted = {s: v if s == OTHER else v**targets.source_power / powers * whole for s, v in shares.items()}
    free = {s: v for s, v in wanted.items() if s == OTHER or v < targets.source_cap}
    excess = sum(v - targets.source_cap for s, v in wanted.items() if s not in free)
    grown = 1 + excess / sum(free.values()) if sum(free.values()) else 1.0
    return {s: v * grown if s in free else targets.source_cap for s, v in wanted.items()}


def rake(counts: Mapping[tuple[str, str, str], int], marginals: list[Mapping[str, float | None]], rounds: int = ROUNDS) -> dict[tuple[str, str, str], float]:
    """The raked share of each cell, all together 1. marginals: for each axis the shares of the
    categories that have a target; the others keep theirs. Warns if a marginal is missed."""
    keys = sorted(k for k, n in counts.items() if n)
    if not keys:
        return {}
    share = np.array([counts[k] for k in keys], float)
    share /= share.sum()
    axes = []
    for i, named in enumerate(marginals):
        names, at = np.unique([k[i] for k in keys], return_inverse=True)
        actual = np.bincount(at, share)
        wanted = np.array([a if (w := named.get(str(n))) is None else w for n, a in zip(names, actual, strict=True)], float)
        axes.append((at, wanted / wanted.sum()))
    for _ in range(rounds):
        before = share
        for at, wanted in axes:
            share = share * (wanted / np.bincount(at, share))[at]
        if np.abs(share - before).max() < 1e-15:
            break
    gap = max(float(np.abs(np.bincount(at, share) - wanted).max()) for at, wanted in axes)
    if gap > GAP:
        warnings.warn(f"the marginals can't all be met: one is missed by {gap:.2g} of all words", stacklevel=2)
    return dict(zip(keys, share.tolist(), strict=True))


def weighted(docs: DataFrame, targets: Targets = DEFAULT, own: str = "mix_", keep: list[str] | None = None) -> DataFrame:
    """docs with the columns source, lang, topic, words, weight, probability and sampled, the names
    of which begin with `own`. Where a few narrow columns of docs are all that is asked for (keep),
    what texts give is written with them, and texts are read once rather than twice."""
    spark = docs.sparkSession
    lang, kind_of, words = f"{own}lang", f"{own}topic", f"{own}words"
    text = F.coalesce("text", F.lit(""))
    found = f"{own}found"
    rows = docs.withColumns({lang: _category("lang", targets.lang), found: F.array_join(F.regexp_extract_all(text, F.lit(EVIDENCE), F.lit(0)), " "), words: F.regexp_count(text, F.lit(WORD)).cast("long"), f"{own}draw": draw(targets.seed), f"{own}given": F.col("source")})
    # columns of their own, so that each is computed once
    rows = rows.withColumn(found, evidence_counts(F.col(found)))
    kind = topic(F.col(found), F.col(words))
    rows = rows.withColumn(kind_of, F.when(kind.isin(sorted(targets.topic)), kind).otherwise(F.lit(OTHER))).drop(found)
    if keep is not None:
        rows = common.written(rows.select(*map(common.quoted, keep), lang, kind_of, words, f"{own}draw", f"{own}given"), "mixing-rows")
    given = f"{own}given"
    counts = common.written(rows.groupBy(F.col(given).alias("source"), F.col(lang).alias("l"), F.col(kind_of).alias("t")).agg(F.sum(words).alias("n")), "mixing")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # those that the targets name, or at most 1 / source_floor
    by_source = counts.where("source is not null").groupBy("source").agg(F.sum("n").alias("n"))
    named = sorted(targets.source) if targets.source is not None else [r.source for r in by_source.where((F.col("n") > 0) & (F.col("n") >= targets.source_floor * total)).select("source").collect()]
    source = _category("source", named)
    # one row for each cell, bounded by the targets
    cells = {(r[0], r[1], r[2]): r[3] for r in counts.groupBy(source.alias("s"), "l", "t").agg(F.sum("n")).collect()}
    shares: dict[str, float] = {}
    for (s, _, _), n in cells.items():
        shares[s] = shares.get(s, 0.0) + n / max(1, total)
    raked = rake(cells, [levelled({s: v for s, v in shares.items() if v}, targets), targets.lang, targets.topic], targets.rounds)
    weights = {k: v * total / cells[k] for k, v in raked.items()}
    most = max(weights.values(), default=1.0)
    table = [(*k, weights.get(k, most), weights.get(k, most) / most) for k in cells]
    names = [f"{own}{x}" for x in ("source", "lang", "topic", "weight", "probability")]
    cell = [f"{own}cell{k}" for k in range(3)]
    table = F.broadcast(spark.createDataFrame(table, ", ".join(f"`{n}` {t}" for n, t in zip([*cell, *names[3:]], ["string"] * 3 + ["double"] * 2, strict=True))))
    rows = rows.withColumn(names[0], _category(given, named))
    # null-safe, as for plain equality the planner would ask of each key whether it is null where texts
    # are read, and work the topic out there once more for each place that names it
    rows = rows.join(table, [rows[n].eqNullSafe(table[c]) for n, c in zip(names[:3], cell, strict=True)])
    columns = [*map(common.quoted, docs.columns if keep is None else keep), *names[:3], words, *names[3:]]
    return rows.select(*columns, (F.col(f"{own}draw") < F.col(f"{own}probability")).alias(f"{own}sampled"))


def draw(seed: int) -> Column:
    """A number from 0 to 1 for a row, by 52 bits of a digest of doc_id and text."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample(docs: DataFrame, targets: Targets = DEFAULT) -> DataFrame:
    own = common.unused(docs.columns, "mix_")
    return weighted(docs, targets, own).where(F.col(f"{own}sampled")).select(*map(common.quoted, docs.columns))
