"""Secret scan with linking of the parts of multipart credentials, in DataFrame operations alone.

Every text is scanned once, by Java's regular expressions, for strong kinds (assignments, access
identifiers, hexadecimal keys) and weak candidates (named identifiers, mixed tokens, endpoints). A
weak candidate is reported only if a part that completes it stands in its scope, the `scope`
characters on either side: a named identifier needs a secret, an endpoint needs one, a mixed token
needs an identifier or an endpoint. That is an interval join: candidates are dealt to the blocks of
`scope` characters that their scope touches, and left-semi joined on (row, block) with the parts, so
no pair is emitted, and what meets in a block is bounded by its characters.

Positions come from the text's pieces between matches: their running length gives the spans, in code
points.

Defined results: a null text is empty and has no spans; equal rows get equal results and stay
separate; a null doc_id is a row like any other; an empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

SCOPE = 200

# The kinds in the order in which they are listed, and their patterns.
KEYWORD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = "(?i:" + KEYWORD.replace(r"([A-Za-z0-9+/_.=-]+)", "") + r")([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:access_?key_?id|client_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
MIXED = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?"""
KINDS = ["assign", "access", "hex", "ident", "mixed", "endpoint"]
PATTERNS = [ASSIGN, ACCESS, HEX, IDENT, MIXED, ENDPOINT]
STRONG = 3
# what each kind is for others: 1 an identifier, 2 a secret, 4 an endpoint; and which of these a weak kind needs
PART = [2, 1, 2, 1, 2, 4]
NEEDS = [0, 0, 0, 2, 5, 2]

SPAN = "array<struct<start:long,kind:int,stop:long>>"


def _fits(kind: int, match: Column, value: Column) -> Column:
    """Whether a match counts: long enough a value, or digits and both cases in a mixed token."""
    if KINDS[kind] == "assign":
        return F.length(value) >= 6
    if KINDS[kind] == "mixed":
        return match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
    return F.lit(True)


def _spans(text: Column, kind: int) -> Column:
    """Spans of all matches of a kind, in order."""
    pattern = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == 0 else matches
    parts = F.zip_with(matches, values, lambda m, v: F.struct(F.length(m).alias("length"), _fits(kind, m, v).alias("fits")))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    found = F.zip_with(gaps, parts, lambda g, p: F.struct(g.alias("gap"), p["length"].alias("length"), p["fits"].alias("fits")))
    def span(at: Column, x: Column) -> Column:
        # the piece behind the last match has no match of its own
        one = F.array(F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["length"]).alias("stop")))
        return F.when(x["fits"], one).otherwise(F.array().cast(SPAN))

    spans = common.scanned(found, lambda x: (x["gap"] + F.coalesce(x["length"], F.lit(0))).cast("long"), span, SPAN)
    # most texts have no match: one search tells, and the rest is for the others
    return F.when(text.rlike(PATTERNS[kind]), spans).otherwise(F.array().cast(SPAN))


def _listed(spans: Column) -> Column:
    """kind:start:end, by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a digest of the text) and the spans of each kind, one array column a kind."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.select("doc_id", F.md5("text").alias("tag"), *[_spans(F.col("text"), k).alias(name) for k, name in enumerate(KINDS)])


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates that a complementary part in scope confirms: doc_id, tag, linked (spans).
    found: what candidates() gave, written."""
    everything = F.concat(*map(F.col, KINDS))
    some = found.where(F.size("ident") + F.size("mixed") + F.size("endpoint") > 0).dropDuplicates(["doc_id", "tag"])
    rows = some.select("doc_id", "tag", F.explode(everything).alias("s")).select("doc_id", "tag", "s.*")
    part = F.get(F.array(*map(F.lit, PART)), F.col("kind"))
    needs = F.get(F.array(*map(F.lit, NEEDS)), F.col("kind"))
    block = lambda at: F.floor(at / scope)
    # a part stands in each block that it touches, a candidate in each that its scope touches
    parts = rows.select(
        F.col("doc_id").alias("p_id"), F.col("tag").alias("p_tag"), part.alias("part"), F.col("start").alias("p_start"), F.col("stop").alias("p_stop"),
        F.explode(F.sequence(block(F.col("start")), block(F.col("stop") - 1))).alias("p_block"),
    )
    weak = rows.where(F.col("kind") >= STRONG).select(
        "doc_id", "tag", "start", "kind", "stop", needs.alias("needs"),
        F.explode(F.sequence(block(F.greatest(F.col("start") - scope, F.lit(0))), block(F.col("stop") + scope - 1))).alias("block"),
    )
    on = (
        F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("tag") == F.col("p_tag")) & (F.col("block") == F.col("p_block"))
        & (F.col("needs").bitwiseAND(F.col("part")) != 0)
        & (F.col("p_start") < F.col("stop") + scope) & (F.col("p_stop") > F.col("start") - scope)
        & ((F.col("p_stop") <= F.col("start")) | (F.col("p_start") >= F.col("stop")))
    )
    hits = weak.join(parts, on, "left_semi")
    return hits.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, the spans of the strong kinds (one column each) and linked, the weak ones confirmed."""
    found = common.written(candidates(docs), "secrets")
    weak = linked(found, scope).select(F.col("doc_id").alias("w_id"), F.col("tag").alias("w_tag"), "linked")
    rows = found.join(weak, found["doc_id"].eqNullSafe(weak["w_id"]) & (found["tag"] == weak["w_tag"]), "left")
    return rows.select(found["doc_id"], *KINDS[:STRONG], F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = F.concat(*map(F.col, KINDS[:STRONG]))
    return scanned.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:STRONG]],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.concat(base, "linked")).alias("spans"),
    )
