"""Statistics over benchmark records: exact medians, ratios, geometric means, ledgers.

Medians are exact (the mean of the middle two where a count is even), since a report compares them
with published ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldlake.functions.sizes import divide, first_non_empty

MIB = 1 << 20

# The groups of a report in the order in which they are declared.
GROUPS = [
    "container parse", "lzma2 single-stream", "lzma2 parallel", "lzma2 near-incompressible", "lzma", "memory budget", "decode ledger", "solid vs non-solid", "aes-256", "filters", "ppmd (secondary)",
    "encode", "encode bcj2", "encode aes-256",
]
# What charts call groups; trees and a chart's headline are told by more than the group.
CHART_NAMES = {
    "lzma2 single-stream": "LZMA2", "lzma2 parallel": "LZMA2", "lzma2 near-incompressible": "LZMA2", "lzma": "LZMA", "stored": "Stored", "aes-256": "AES-256", "encode aes-256": "AES-256",
    "filters": "BCJ / BCJ2 / delta", "ppmd (secondary)": "PPMd", "encode bcj2": "BCJ2",
}
# The numbers of a decode's ledger that a summary has as they are, the largest of a
# run's, and all series of a summary.
LEDGER_MAXIMA = ["threads", "worker_threads", "budget_bytes", "dictionary_bytes"]
LEDGER_SERIES = [
    "peak_held_bytes", "peak_queue_bytes", "peak_queue_capacity_bytes", "peak_spill_bytes", "peak_total_bytes", "peak_runs_out", "peak_runs_pending", "runs", "chase_bytes", "wave_count",
    "refused_feeds", "refused_at_boundary", "refused_at_boundary_busy", "refused_mid_run", "refused_run_pending", "gate_refusals", "backlog_stops", "waits",
]
LEDGER_DERIVED = ["rss", "dictionaries", "touched", "nominal", "remainder", "runs_per_wave", "wait_seconds", "idle_worker_seconds", "mean_runs_out_asleep"]


def stat(x: Column) -> Column:
    """median, min, max and n of the values that are there; zeros where there are none."""
    zero = F.lit(0).cast("double")
    return F.struct(
        F.coalesce(F.median(x), zero).alias("median"), F.coalesce(F.min(x).cast("double"), zero).alias("min"),
        F.coalesce(F.max(x).cast("double"), zero).alias("max"), F.count(x).alias("n"),
    )


def integer_median(x: Column) -> Column:
    """The median as a whole number, halves away from zero."""
    return F.round(F.median(x)).cast("long")


def measured(runs: DataFrame) -> DataFrame:
    """Runs that count: no warm-ups, but failures even of these."""
    return runs.where(~(F.col("warmup") & (F.col("status") == "ok")))


def summarize(runs: DataFrame) -> DataFrame:
    """One row for each scenario and variant: stats of wall, cpu, rss and load, bytes, throughput,
    how many went well, the failures, and the distinct extras in first-seen order."""
    rows = measured(runs)
    good = F.col("status") == "ok"
    of = lambda c: F.when(good, c)
    order = F.struct("seq")
    out = rows.groupBy("scenario", "variant").agg(
        F.first("group").alias("group"), F.first("op").alias("op"), F.first("role").alias("role"),
        stat(of(F.col("wall_seconds"))).alias("wall"), stat(of(F.col("user_seconds") + F.col("sys_seconds"))).alias("cpu"),
        stat(of(F.col("max_rss_bytes").cast("double"))).alias("rss"), stat(of(F.col("load_average"))).alias("load"),
        F.max_by(of(F.col("bytes_in")), F.when(good, order)).alias("bytes_in"), integer_median(of(F.col("bytes_out"))).alias("bytes_out"),
        F.count_if(good).alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "dnf").alias("dnf"),
        F.transform(F.sort_array(F.collect_list(F.when(~good, F.struct("seq", "failure")))), lambda x: x["failure"]).alias("failures"),
        F.sort_array(F.collect_list(F.when(F.col("extra") != "", F.struct("seq", "extra")))).alias("x"),
    )
    out = out.withColumn("extra", F.array_join(F.array_distinct(F.transform("x", lambda x: x["extra"])), "; ")).drop("x")
    moved = F.when(F.col("op") == "encode", F.col("bytes_in")).otherwise(F.col("bytes_out"))
    return out.withColumn("throughput_mib_s", divide(moved / MIB, F.col("wall.median")))


def ratios(summary: DataFrame) -> DataFrame:
    """Each candidate against each reference of its scenario: reference over candidate, so above one
    the candidate is better. Sizes are compared where something is written."""
    c = summary.where("role = 'candidate'").alias("c")
    r = summary.where("role <> 'candidate'").alias("r")
    both = c.join(r, F.col("c.scenario") == F.col("r.scenario"))
    return both.select(
        "c.scenario", "c.group", "c.variant", F.col("r.variant").alias("reference"), F.col("r.role").alias("reference_role"),
        *[divide(F.col(f"r.{x}.median"), F.col(f"c.{x}.median")).alias(x) for x in ("wall", "cpu", "rss")],
        F.when(F.col("c.op") == "encode", divide(F.col("r.bytes_out").cast("double"), F.col("c.bytes_out").cast("double"))).alias("size"),
    )


def category(group: Column, scenario: Column, threads: Column) -> Column:
    """The bars of a chart that a scenario is averaged into: the kind of work, and whether one thread
    does it. Trees are told by their ids, and extraction through one stream is a kind of its own."""
    tree = F.when(scenario.contains("nonsolid") | scenario.contains("non-solid"), "Non-solid trees").otherwise("Solid trees")
    named = F.lit(None).cast("string")
    for key, name in reversed(CHART_NAMES.items()):
        named = F.when(group == key, name).otherwise(named)
    kind = (
        F.when(scenario.endswith("/stream"), "Streamed extract")
        .when((group == "encode") & scenario.startswith("encode/payload-sub/"), "LZMA2")
        .when(group.isin("encode", "solid vs non-solid"), tree)
        .otherwise(F.coalesce(named, group))
    )
    return F.when(group == "container parse", "Listing").otherwise(F.concat(kind, F.when(threads == "1", ", 1 thread").otherwise(", multi-thread")))


def chart_op(op: Column) -> Column:
    """The chart that a scenario belongs on: lists stand with decodes."""
    return F.when(op == "encode", op).otherwise("decode")


def excluded(group: Column, adaptive: Column, memory_limit: Column) -> Column:
    """Whether a scenario stays off the charts' categories: it measures a bound, or repeats another."""
    return group.isin("memory budget", "decode ledger") | F.coalesce(adaptive, F.lit(False)) | (F.coalesce(memory_limit, F.lit(0)) != 0)


def headline(group: Column, op: Column, adaptive: Column, memory_limit: Column) -> Column:
    """The headline that a scenario counts in (`All decode`, `All encode`), or null."""
    off = (group == "memory budget") | F.coalesce(adaptive, F.lit(False)) | (F.coalesce(memory_limit, F.lit(0)) != 0)
    return F.when(~off & op.isin("decode", "encode"), F.concat(F.lit("All "), op))


def geomean(x: Column) -> Column:
    """Of the positive values; null where there are none."""
    return F.exp(F.avg(F.when(x > 0, F.ln(x))))


def geomeans_by_category(ratios: DataFrame, values: tuple[str, ...] = ("wall",), hosts: DataFrame | None = None) -> DataFrame:
    """category, variant, hosts, scenarios and the mean of each value (mean, and mean_x of the others):
    a geometric mean for each host, and theirs over hosts, where every host has the same scenarios.
    ratios: host, category, variant, scenario and the values; a scenario counts if it has them all.
    hosts: all that reported, those of ratios if none are given."""
    rows = ratios
    for v in values:
        rows = rows.where(F.col(v) > 0)
    means = {v: "mean" if i == 0 else f"mean_{v}" for i, v in enumerate(values)}
    each = rows.groupBy("category", "variant", "host").agg(*[geomean(F.col(v)).alias(m) for v, m in means.items()], F.sort_array(F.collect_list("scenario")).alias("ids"))
    out = each.groupBy("category", "variant").agg(*[geomean(F.col(m)).alias(m) for m in means.values()], F.count("*").alias("hosts"), F.first(F.size("ids")).cast("long").alias("scenarios"), F.countDistinct("ids").alias("sets"))
    reported = (ratios if hosts is None else hosts).agg(F.countDistinct("host")).scalar()
    return out.where((F.col("sets") == 1) & (F.col("hosts") == reported)).drop("sets")


def chart_order(bars: DataFrame, lead: str = "mean") -> DataFrame:
    """bars (chart, category, first_seen, and the mean of the tool that leads, null if it has no bar)
    with position: the headline first, then best first and, where means are equal, first seen first.
    A chart without its headline is in first-seen order."""
    head = F.col("category") == F.concat(F.lit("All "), F.col("chart"))
    has = F.max(head).over(Window.partitionBy("chart"))
    order = Window.partitionBy("chart").orderBy(F.col("head").desc(), F.when(F.col("has") & ~F.col("head"), F.coalesce(lead, F.lit(0.0))).desc(), "first_seen")
    return bars.withColumn("head", head).withColumn("has", has).withColumn("position", F.row_number().over(order) - 1).drop("head", "has")


def in_group_order(rows: DataFrame, by: str, seen: str, groups: list[str] = GROUPS) -> DataFrame:
    """rows with position in each `by`: groups as they are declared, an undeclared one with the first,
    and rows of a group in the order in which they were seen."""
    at = F.array_position(F.array(*map(F.lit, groups)), F.col("group"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(F.greatest(at, F.lit(1)), seen)) - 1)


def common_scenarios(runs: DataFrame) -> DataFrame:
    """scenario, common: whether every host ran it."""
    hosts = runs.agg(F.countDistinct("host")).scalar()
    return runs.groupBy("scenario").agg(F.countDistinct("host").alias("n")).select("scenario", (F.col("n") == hosts).alias("common"))


def workload_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of two workloads (key, value) that don't have the same value on both sides."""
    rows = a.select("key", F.col("value").alias("a"), F.lit(True).alias("in_a")).join(b.select("key", F.col("value").alias("b"), F.lit(True).alias("in_b")), "key", "full")
    return rows.where(~(F.col("in_a").eqNullSafe(F.col("in_b")) & F.col("a").eqNullSafe(F.col("b")))).select("key", "a", "b")


def host_pivot(summary: DataFrame, hosts: list[str], value: str = "wall") -> DataFrame:
    """One row for each scenario and variant, a column for each host, `-` where it has none."""
    out = summary.groupBy("scenario", "variant").pivot("host", hosts).agg(F.first(value))
    return out.select("scenario", "variant", *[F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("-")).alias(h) for h in hosts])


def worst(rows: DataFrame, n: int = 5, by: str = "host") -> DataFrame:
    """The n smallest ratios of each host with their rank; rows without a ratio aren't listed."""
    order = Window.partitionBy(by).orderBy(F.col("ratio").isNull(), "ratio", "scenario", "variant")
    return rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= n) & F.col("ratio").isNotNull())


def group_heads(rows: DataFrame, order: str, group: str) -> DataFrame:
    """rows with head, tail: whether the row begins or ends its group in this order."""
    w = Window.orderBy(order) if "report" not in rows.columns else Window.partitionBy("report").orderBy(order)
    return rows.withColumns({"head": ~F.col(group).eqNullSafe(F.lag(group).over(w)) | F.lag(order).over(w).isNull(), "tail": ~F.col(group).eqNullSafe(F.lead(group).over(w)) | F.lead(order).over(w).isNull()})


def run_order(variants: DataFrame, passes: int) -> DataFrame:
    """scenario, pass, position, variant: even passes forwards, odd ones backwards."""
    rows = variants.select("scenario", "variant", "variant_index", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    sign = F.when(F.col("pass") % 2 == 0, F.col("variant_index")).otherwise(-F.col("variant_index"))
    w = Window.partitionBy("scenario", "pass").orderBy(sign)
    return rows.withColumn("position", F.row_number().over(w) - 1).select("scenario", "pass", "position", "variant")


def process_count(scenarios: DataFrame) -> DataFrame:
    """How many processes a plan starts: variants times repeats and warm-ups. scenarios: variants
    (array), repeats, warmups."""
    return scenarios.agg(F.sum(F.size("variants") * (F.col("repeats") + F.col("warmups"))).cast("long").alias("processes"))


def failures_by_role(summary: DataFrame) -> DataFrame:
    """primary or secondary, scenario, variant, failure."""
    role = F.when(F.col("role") == "secondary", "secondary").otherwise("primary")
    return summary.select(role.alias("kind"), "scenario", "variant", F.explode("failures").alias("failure"))


def source_tags(rows: DataFrame, *by: str) -> DataFrame:
    """Distinct tags of a group, sorted, joined by `+`."""
    return rows.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set("tag")), "+").alias("tags"))


def ledger_idle(ledgers: DataFrame) -> DataFrame:
    """id, slept, idle, mean_busy of ledgers (id, threads, waits ARRAY): waits[k] is how long k
    runs were out; idle is the threads that had none, over that time."""
    rows = ledgers.select("id", "threads", F.posexplode("waits").alias("busy", "slept"))
    out = rows.groupBy("id").agg(
        F.sum("slept").alias("slept"), F.sum(F.col("slept") * F.greatest(F.col("threads") - F.col("busy"), F.lit(0))).alias("idle"), F.sum(F.col("slept") * F.col("busy")).alias("busy_time"),
    )
    return out.select("id", "slept", "idle", divide(F.col("busy_time").cast("double"), F.col("slept").cast("double")).alias("mean_busy"))


def ledger_summary(runs: DataFrame) -> DataFrame:
    """One row for each scenario and variant of which a run that went well has a ledger: the largest
    of four numbers, median, min, max and n of each series, and the waves and waits of the first such
    run. runs: scenario, variant, seq, status, max_rss_bytes, and ledger_x for the blocks, the maxima,
    the series, wave_runs, wave_runs_out and wait_nanos_by_runs_out."""
    get = lambda name: F.coalesce(F.col(f"ledger_{name}").cast("double"), F.lit(0.0))
    rows = runs.where("status = 'ok' and coalesce(ledger_blocks, 0) <> 0")
    slept = F.transform(F.coalesce("ledger_wait_nanos_by_runs_out", F.array().cast("array<long>")), lambda n, busy: F.struct((n / 1e9).alias("s"), busy.cast("double").alias("busy")))
    total = lambda value: F.aggregate("slept", F.lit(0.0), lambda acc, x: acc + value(x))
    rows = rows.withColumns({"slept": slept, "rss": F.col("max_rss_bytes").cast("double"), "dictionaries": F.when(get("chase_bytes") > 0, get("dictionary_bytes")).otherwise(0.0)})
    rows = rows.withColumns({
        "touched": F.least("dictionaries", get("chase_bytes")),
        "nominal": get("dictionary_bytes") * (get("worker_threads") + F.when(get("chase_bytes") > 0, 1.0).otherwise(0.0)),
        "remainder": F.col("rss") - get("peak_total_bytes") - F.col("dictionaries"),
        "runs_per_wave": F.when(get("wave_count") > 0, get("runs") / get("wave_count")),
        "wait_seconds": total(lambda x: x["s"]),
        "idle_worker_seconds": total(lambda x: x["s"] * F.greatest(get("threads") - x["busy"], F.lit(0.0))),
        "busy_seconds": total(lambda x: x["s"] * x["busy"]),
    })
    rows = rows.withColumn("mean_runs_out_asleep", F.when(F.col("wait_seconds") > 0, F.col("busy_seconds") / F.col("wait_seconds")))
    first = lambda c: F.min_by(c, "seq")
    return rows.groupBy("scenario", "variant").agg(
        *[F.max(get(x)).cast("long").alias(x) for x in LEDGER_MAXIMA],
        *[stat(get(x)).alias(x) for x in LEDGER_SERIES],
        *[stat(F.col(x)).alias(x) for x in LEDGER_DERIVED],
        first(F.col("ledger_wave_runs")).alias("wave_runs"), first(F.col("ledger_wave_runs_out")).alias("wave_runs_out"), first(F.transform("slept", lambda x: x["s"])).alias("wait_seconds_by_runs_out"),
    )


def accumulate_ledgers(ledgers: DataFrame, peaks: list[str], counts: list[str]) -> DataFrame:
    """A reader's ledger over its blocks: peaks by their largest, counts by their sum."""
    return ledgers.groupBy("reader").agg(*[F.max(c).alias(c) for c in peaks], *[F.sum(c).alias(c) for c in counts])


def run_lengths(rows: DataFrame, by: str, order: str, value: str, cap: int = 24) -> DataFrame:
    """by, folded: values in order as `4 3 1x3 2`, equal neighbours folded, at most `cap` terms and
    then an ellipsis."""
    w = Window.partitionBy(by).orderBy(order)
    start = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(order).over(w).isNull()
    islands = rows.withColumn("island", F.sum(start.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    terms = islands.groupBy(by, "island").agg(F.first(value).cast("string").alias("v"), F.count("*").alias("n"))
    terms = terms.where(F.col("island") <= cap + 1)
    term = F.when(F.col("island") > cap, F.lit("...")).when(F.col("n") > 1, F.concat("v", F.lit("x"), F.col("n").cast("string"))).otherwise(F.col("v"))
    listed = F.sort_array(F.collect_list(F.struct("island", term.alias("t"))))
    return terms.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("folded"))


def resolve_threads(threads: Column, cpus: Column) -> Column:
    """"all" is the number of CPUs."""
    return F.when(threads == "all", cpus).otherwise(threads.try_cast("int"))


def only(scenarios: DataFrame, needles: list[str]) -> DataFrame:
    """Scenarios whose id contains one of the needles; all if there are none."""
    if not needles:
        return scenarios
    return scenarios.where(F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(F.col("id"), n)))
