"""Preference formatting: the common turns of two conversations once as prompt, the rest as paired,
masked completions. DataFrame operations alone.

The first turn at which the two conversations differ is a minimum over digests of single turns, so no
text moves to find it. Texts move twice: runs of `RUN` turn numbers of a side are put in order first,
spread over all tasks even where a few conversations hold most rows, and then the runs of a pair meet
and are rendered to its three texts.

Places are turn numbers, so a turn that one side lacks is a difference. The mask of a completion lists
the spans (start:end in code points, end exclusive) of what the assistant says with its end mark,
the parts on which a loss counts; a prompt has none.

Defined results: rows that repeat (pair, side, turn, role, text) count once; different rows of one
turn number are put in the order of role and text, and are common only all together; null text is
empty, a null role is "user"; rows with a null pair or turn are left out; a pair with one side only has
no prompt and an empty other completion; an empty table gives an empty result. A pair's texts are cells
of one row, as its result asks for, so a pair may have 2 GB of text at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

RUN = 64
MASK = "array<struct<a:long,b:long>>"
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """Pairs out of a table of conversations: the ids 2n (chosen) and 2n + 1 (rejected) are pair n."""
    return conversations.select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "turn", "role", "text",
    )


def cleaned(turns: DataFrame) -> DataFrame:
    return turns.where("pair_id is not null and turn is not null").select("pair_id", "side", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def prompt_ends(turns: DataFrame) -> DataFrame:
    """pair_id, end: the first turn at which the sides differ; null if none."""
    digest = F.md5(F.concat("role", F.lit("\0"), "text"))
    of = lambda side: F.sort_array(F.collect_set(F.when(F.col("side") == side, digest)))
    each = turns.groupBy("pair_id", "turn").agg((of("chosen") == of("rejected")).alias("same"))
    return each.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("end"))


def _join(parts: Column) -> Column:
    """One (text, mask, n) of sorted parts of that kind; a part's mask moves by the texts before it."""
    def moved(at: Column, x: Column) -> Column:
        return F.transform(x["mask"], lambda m: F.struct((m["a"] + at).alias("a"), (m["b"] + at).alias("b")))

    mask = common.scanned(parts, lambda x: F.length(x["text"]).cast("long"), moved, MASK)
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return F.struct(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), mask.alias("mask"), n.alias("n"))


def _rendered(parts: Column, masked: bool) -> Column:
    """Parts (turn, role, text) in order as one (text, mask, n)."""

    def one(x: Column) -> Column:
        text = F.concat(F.lit(OPEN), x["role"], F.lit(CLOSE), x["text"], F.lit(END))
        none = F.array().cast(MASK)
        says = F.array(F.struct((F.length(text) - F.length(x["text"]) - len(END)).cast("long").alias("a"), F.length(text).cast("long").alias("b")))
        mask = F.when(x["role"] == "assistant", says).otherwise(none) if masked else none
        return F.struct(text.alias("text"), mask.alias("mask"), F.lit(1).cast("long").alias("n"))

    return _join(F.transform(parts, one))


def pairs(turns: DataFrame, run: int = RUN) -> DataFrame:
    """pair_id, prompt, chosen, rejected, their numbers of turns, and the masks of the completions.
    turns: pair_id, side (chosen or rejected), turn, role, text."""
    rows = cleaned(turns)
    runs = rows.groupBy("pair_id", "side", F.floor(F.col("turn") / run).alias("run")).agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("parts"))
    runs = runs.join(prompt_ends(rows), "pair_id")
    common = lambda x: F.col("end").isNull() | (x["turn"] < F.col("end"))
    chosen = F.col("side") == "chosen"
    runs = runs.select(
        "pair_id", "side", "run",
        F.when(chosen, _rendered(F.filter("parts", common), False)).alias("prompt"),
        _rendered(F.filter("parts", lambda x: ~common(x)), True).alias("rest"),
    )
    whole = runs.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("side", "run", "prompt", "rest"))).alias("runs"))
    own = lambda side, what: _join(F.transform(F.filter("runs", lambda x: x["side"] == side), lambda x: x[what]))
    out = whole.select("pair_id", own("chosen", "prompt").alias("prompt"), own("chosen", "rest").alias("chosen"), own("rejected", "rest").alias("rejected"))
    listed = lambda s: F.array_join(F.transform(F.col(f"{s}.mask"), lambda m: F.concat_ws(":", m["a"].cast("string"), m["b"].cast("string"))), ",")
    return out.select(
        "pair_id",
        *[F.col(f"{s}.n").alias(f"n_{s}") for s in ("prompt", "chosen", "rejected")],
        *[F.col(f"{s}.text").alias(s) for s in ("prompt", "chosen", "rejected")],
        listed("chosen").alias("chosen_mask"),
        listed("rejected").alias("rejected_mask"),
    )
