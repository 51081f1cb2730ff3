"""Analytics over the history of runs: summaries, hotspots, budget suggestions, archived totals.

All reports are single aggregations over the hydrated rows; nothing is collected. Percentiles are nearest-rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linelore.functions.fingerprint import resolved_fingerprint

# Fixed values of the reports.
CONFIDENCE = {
    "high": ("git-status", "git-log", "go-test-json", "vitest-json", "jest-json"),
    "medium": ("git-diff", "go-build", "generic-test", "js-package-test"),
    "low": ("generic-summary", "passthrough"),
}
POOR_SAVINGS_PCT = 40.0
RETAIN_RECORDS = 2500
WINDOW_TOKENS = 200_000
WS = r"[\s\x0B\x85\xA0]+"


def words(c: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(c, f"^{WS}|{WS}$", ""), WS, " "), " ")


def command_key(c: Column) -> Column:
    """The first three words of a command."""
    return F.array_join(F.slice(words(c), 1, 3), " ")


def excluded_command(c: Column, own: Sequence[str] = ()) -> Column:
    """Commands kept out of savings: ``uninstall``, bare or behind one of the names (``own``) that the tool itself runs under."""
    w = words(F.lower(c))
    first, second = F.element_at(w, 1), F.coalesce(F.try_element_at(w, F.lit(2)), F.lit(""))
    wrapped = first.isin(*own) & (second == "uninstall") if own else F.lit(False)
    return (first == "uninstall") | wrapped


def hydrate(df: DataFrame) -> DataFrame:
    """Fields that older rows lack, from those they have; absent numbers are 0, absent flags false."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    nz = lambda *cs: F.coalesce(*[F.when(c != 0, c) for c in cs], F.lit(0).cast("bigint"))
    conf = F.lit("")
    for name, profiles in CONFIDENCE.items():
        conf = F.when(F.col("profile").isin(*profiles), name).otherwise(conf)
    read = nz(n("raw_bytes_read"), n("raw_bytes"), F.when(n("raw_tokens") > 0, n("raw_tokens") * 4).otherwise(0))
    df = df.withColumns(
        {
            "command_fingerprint": resolved_fingerprint(F.when(F.col("command_fingerprint") != "", F.col("command_fingerprint")), F.col("command")),
            "profile_confidence": F.when(F.coalesce(F.col("profile_confidence"), F.lit("")) == "", conf).otherwise(F.col("profile_confidence")),
            "raw_bytes_read": read,
            "bytes_emitted": nz(n("bytes_emitted"), n("filtered_bytes"), F.when(n("filtered_tokens") > 0, n("filtered_tokens") * 4).otherwise(0)),
            "fallback_used": b("fallback_used") | (F.coalesce(F.col("profile"), F.lit("")) == "passthrough"),
            "empty_result": b("empty_result"),
            "passthrough": b("passthrough"),
            **{c: n(c) for c in ("duration_ms", "exit_code", "raw_bytes", "filtered_bytes", "raw_tokens", "filtered_tokens", "saved_tokens")},
            "savings_pct": F.coalesce(F.col("savings_pct"), F.lit(0.0)),
            "tee_path": F.coalesce(F.col("tee_path"), F.lit("")),
        }
    )
    return df.withColumn("bytes_parsed", nz(n("bytes_parsed"), F.col("raw_bytes_read")))


def percent(count: Column, total: Column) -> Column:
    return F.when(total > 0, count.cast("double") * 100 / total).otherwise(0.0)


def nearest_rank(c: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})").cast("bigint")


def with_percentiles(h: DataFrame, groups: Sequence[str], value: str, ps: dict[str, float]) -> DataFrame:
    """``groups`` and nearest-rank percentiles of a whole-numbered value, for few groups of any size.

    Values are counted first. The place is then looked for in two steps, among the values' ranges of 65,536 and within the
    one range that holds it, so a task sees the ranges of a group or the values of one range, never all values.
    """
    v = h.groupBy(*groups, F.col(value).cast("bigint").alias("v")).agg(F.count("*").alias("n")).withColumn("hi", F.shiftright("v", 16))
    w = Window.partitionBy(*groups)  # ranges of a group
    r = v.groupBy(*groups, "hi").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(w)).withColumn("before", F.sum("n").over(w.orderBy("hi")) - F.col("n"))
    place = F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(F.lit(1), F.floor((F.col("total") * F.lit(round(p * 1000)) + 999) / 1000)).alias("at")) for k, p in ps.items()])
    r = r.select(*groups, "hi", "n", "before", F.explode(place).alias("p")).where("p.at > before and p.at <= before + n")
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
    on = F.col("a.hi") == F.col("b.hi")
    for c in same:
        on &= c
    inner = v.alias("a").join(r.alias("b"), on).select(*[F.col(f"a.{g}").alias(g) for g in groups], "a.v", F.col("a.n").alias("n"), "b.p.name", (F.col("b.p.at") - F.col("b.before")).alias("at"))
    inner = inner.withColumn("upto", F.sum("n").over(Window.partitionBy(*groups, "name").orderBy("v"))).where("upto >= at")
    return inner.groupBy(*groups).agg(*[F.min(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ps])


def exact_sum(c: str) -> Column:
    """Sum of percentages with two decimals, free of rounding in any order of rows."""
    return F.sum(F.col(c).cast("decimal(18,4)")).cast("double")


def counters() -> dict[str, Column]:
    """The additive counters of a set of runs."""
    return {
        "commands": F.count("*"),
        "raw_tokens": F.sum("raw_tokens"),
        "filtered_tokens": F.sum("filtered_tokens"),
        "saved_tokens": F.sum("saved_tokens"),
        "passthrough_commands": F.count_if(F.col("passthrough")),
        "passthrough_tokens": F.sum(F.when(F.col("passthrough"), F.col("raw_tokens")).otherwise(0)),
        "total_duration_ms": F.sum("duration_ms"),
        "failures": F.count_if(F.col("exit_code") != 0),
        "fallbacks": F.count_if(F.col("fallback_used")),
        "empty_results": F.count_if(F.col("empty_result")),
        "tee_count": F.count_if(F.col("tee_path") != ""),
        "raw_bytes_read": F.sum("raw_bytes_read"),
        "bytes_parsed": F.sum("bytes_parsed"),
        "bytes_emitted": F.sum("bytes_emitted"),
        "savings_pct_sum": F.coalesce(F.sum(F.when(~F.col("passthrough"), F.col("savings_pct").cast("decimal(18,4)"))).cast("double"), F.lit(0.0)),
    }


def fold_totals(df: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """Additive counters of archived rows: one row, combinable with others by adding. ``own``: see ``excluded_command``."""
    h = hydrate(df).where(~F.coalesce(excluded_command(F.col("command"), own), F.lit(False)))
    return h.agg(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in counters().items()])


def combine_totals(*parts: DataFrame) -> DataFrame:
    """Totals of several parts added up, with the rates that follow from them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_rates(out.agg(*[F.sum(k).alias(k) for k in counters()]))


def with_rates(t: DataFrame) -> DataFrame:
    n = F.col("commands")
    samples = n - F.col("passthrough_commands")
    return t.withColumns(
        {
            "average_pct": F.when(samples > 0, F.col("savings_pct_sum") / samples).otherwise(0.0),
            "filtered_savings_pct": percent(F.col("saved_tokens"), F.col("raw_tokens") - F.col("passthrough_tokens")),
            "failure_rate": percent(F.col("failures"), n),
            "fallback_rate": percent(F.col("fallbacks"), n),
            "empty_result_rate": percent(F.col("empty_results"), n),
            "tee_rate": percent(F.col("tee_count"), n),
        }
    )


_DURATIONS = {"duration_p50_ms": 0.5, "duration_p95_ms": 0.95}


def summary(df: DataFrame) -> DataFrame:
    """One row: counts, sums, rates, and the median and 95th percentile of durations of all runs."""
    h = hydrate(df)
    one = F.lit(1).alias("k")
    t = h.agg(one, *[F.coalesce(c, F.lit(0)).alias(k) for k, c in counters().items()])
    q = with_percentiles(h.select(one, "duration_ms"), ["k"], "duration_ms", _DURATIONS)
    t = t.join(q, "k", "left").drop("k")
    return with_rates(t.withColumns({k: F.coalesce(F.col(k), F.lit(0)) for k in _DURATIONS})).drop("savings_pct_sum")


def by_command(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs by the first three words of their command, most frequent first."""
    h = hydrate(df).where(~F.col("passthrough"))
    g = h.groupBy(command_key(F.col("command")).alias("command")).agg(
        F.count("*").alias("count"), (exact_sum("savings_pct") / F.count("*")).alias("average_pct"), *[F.sum(c).alias(c) for c in ("saved_tokens", "raw_tokens", "filtered_tokens")]
    )
    return g.orderBy(F.desc("count"), "command").limit(limit) if limit else g


def by_profile(df: DataFrame) -> DataFrame:
    """Runs by profile with rates, percentiles and the most frequent confidence (of equal ones the smallest)."""
    h = hydrate(df).where(~F.col("passthrough"))
    conf = h.where("profile_confidence <> ''").groupBy("profile", "profile_confidence").agg(F.count("*").alias("n"))
    conf = conf.groupBy("profile").agg(F.min_by("profile_confidence", F.struct(-F.col("n"), "profile_confidence")).alias("confidence"))
    n = F.count("*")
    g = h.groupBy("profile").agg(
        n.alias("commands"),
        (exact_sum("savings_pct") / n).alias("average_pct"),
        *[F.sum(c).alias(c) for c in ("saved_tokens", "raw_tokens", "filtered_tokens")],
        percent(F.count_if(F.col("exit_code") != 0), n).alias("failure_rate"),
        percent(F.count_if(F.col("fallback_used")), n).alias("fallback_rate"),
        percent(F.count_if(F.col("empty_result")), n).alias("empty_result_rate"),
        percent(F.count_if(F.col("tee_path") != ""), n).alias("tee_rate"),
    )
    q = with_percentiles(h, ["profile"], "duration_ms", _DURATIONS).withColumnRenamed("profile", "p")
    g = g.join(q, F.col("profile").eqNullSafe(F.col("p"))).drop("p")
    return g.join(conf, "profile", "left").withColumn("confidence", F.coalesce("confidence", F.lit("")))


def profile_histogram(df: DataFrame) -> DataFrame:
    """Runs of each profile, raw ones too."""
    return df.groupBy("profile").agg(F.count("*").alias("n"))


def _weight(tokens: Column, floor: int) -> Column:
    return F.when(tokens > 0, tokens.cast("double") / (tokens + floor)).otherwise(0.0)


def hotspot_severity(avg: Column, failure: Column, fallback: Column, p95: Column, n: Column, raw: Column, filtered: Column) -> Column:
    """How much a command would gain by a better profile."""
    most = F.greatest(raw, filtered).cast("double")
    volume = _weight(raw, 64)
    worth = (raw >= 96) | (filtered >= 72)
    fell = raw.cast("double") * (fallback / 100) * 0.25
    fell = F.when((fallback >= 50) & worth, fell + most * (fallback / 100) * 0.20).otherwise(fell)
    tiny = (raw < 32) & (filtered < 32) & (avg >= -20)
    target = F.when((raw >= 1024) | (filtered >= 768), 18.0).when((raw >= 256) | (filtered >= 192), 12.0).otherwise(8.0)
    poor = F.when(worth, F.greatest(F.lit(0.0), target - avg) * most / 110).when(tiny, 0.0).otherwise(F.greatest(F.lit(0.0), -avg) * raw.cast("double") / 200)
    slow = F.greatest(F.lit(0.0), p95.cast("double") - 75) * volume / 6
    total = filtered.cast("double") * volume * 0.85 + fell + raw.cast("double") * (failure / 100) * 0.20 + slow + poor
    return total * (1 + _weight(n * 16, 24))


def command_hotspots(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Commands by profile that save little or fall back often, worst first."""
    h = hydrate(df).where("not passthrough and raw_tokens > 0")
    n = F.count("*")
    g = h.groupBy(command_key(F.col("command")).alias("command"), "profile").agg(
        n.alias("commands"),
        (exact_sum("savings_pct") / n).alias("average_pct"),
        percent(F.count_if(F.col("exit_code") != 0), n).alias("failure_rate"),
        percent(F.count_if(F.col("fallback_used")), n).alias("fallback_rate"),
        nearest_rank("duration_ms", 0.5).alias("duration_p50_ms"),
        nearest_rank("duration_ms", 0.95).alias("duration_p95_ms"),
        F.sum("raw_tokens").alias("raw"),
        F.sum("filtered_tokens").alias("filtered"),
    )
    c = F.col
    g = g.withColumn("severity", F.round(hotspot_severity(c("average_pct"), c("failure_rate"), c("fallback_rate"), c("duration_p95_ms"), c("commands"), c("raw"), c("filtered")), 4))
    g = g.where(~((c("commands") < 2) & (c("raw") < 48) & (c("average_pct") >= 0) & (c("fallback_rate") == 0) & (c("failure_rate") == 0)))
    g = g.where(~((c("average_pct") >= POOR_SAVINGS_PCT) & (c("fallback_rate") < 50))).drop("raw", "filtered")
    return g.orderBy(F.desc("severity"), F.desc("commands"), "command", "profile").limit(limit) if limit else g


def fingerprint_hotspots(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Commands with poor savings; those that still emit most tokens first."""
    h = hydrate(df).where("not passthrough and raw_tokens > 0")
    n = F.count("*")
    g = h.groupBy(F.col("command_fingerprint").alias("fingerprint")).agg(
        F.min_by("command", "seq").alias("command"),
        F.min_by("profile", "seq").alias("profile"),
        n.alias("commands"),
        (exact_sum("savings_pct") / n).alias("average_pct"),
        nearest_rank("duration_ms", 0.5).alias("duration_p50_ms"),
        nearest_rank("duration_ms", 0.95).alias("duration_p95_ms"),
        F.sum("raw_tokens").alias("raw"),
        F.sum("filtered_tokens").alias("residual"),
    )
    g = g.where((F.col("average_pct") < POOR_SAVINGS_PCT) & ~((F.col("commands") < 2) & ((F.col("average_pct") >= 0) | (F.col("raw") < 16) | ((F.col("raw") < 24) & (F.col("average_pct") > -25)))))
    g = g.drop("raw")
    return g.orderBy(F.desc("residual"), "average_pct", F.desc("commands"), "command").limit(limit) if limit else g


def _ceil_scale(v: Column, num: int, den: int) -> Column:
    return F.when(v > 0, F.floor((v * num + (den - 1)) / den)).otherwise(0).cast("bigint")


def budget_suggestions(df: DataFrame, lookback: int | None = 200, min_samples: int = 3, limit: int | None = None) -> DataFrame:
    """Tighter or looser output budgets for commands, from their last runs (``lookback`` None: all of them)."""
    if lookback:
        df = df.orderBy(F.desc_nulls_last("timestamp"), F.desc("seq")).limit(lookback)
    h = hydrate(df).where("command_fingerprint <> '' and not passthrough")
    prof = h.groupBy("command_fingerprint", "profile").agg(F.count("*").alias("n")).groupBy("command_fingerprint").agg(F.min_by("profile", F.struct(-F.col("n"), "profile")).alias("profile"))
    n = F.count("*")
    pct = {f"{a}_{b}": nearest_rank(b, p) for a, p in (("median", 0.5), ("p95", 0.95)) for b in ("raw_tokens", "filtered_tokens", "bytes_emitted")}
    g = h.groupBy("command_fingerprint").agg(
        n.alias("samples"),
        F.max_by("command", F.struct("timestamp", -F.col("seq"))).alias("command"),
        (exact_sum("savings_pct") / n).alias("average_savings_pct"),
        percent(F.count_if(F.col("fallback_used") & ~F.col("empty_result")), n).alias("fallback_rate"),
        percent(F.count_if(F.col("exit_code") != 0), n).alias("failure_rate"),
        *[c.alias(k) for k, c in pct.items()],
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    ).where(F.col("samples") >= min_samples)
    c = F.col
    able = c("failure_rate") <= 80.0
    reason = (
        F.when((c("fallback_rate") >= 50) & able, "fallback_heavy")
        .when((c("average_savings_pct") >= 92) & (c("median_raw_tokens") >= 80) & (c("median_filtered_tokens") <= 20) & able, "aggressive_compression")
        .when((c("average_savings_pct") <= 35) & (c("median_filtered_tokens") >= 48) & (c("fallback_rate") <= 25), "noisy")
    )
    g = g.withColumn("reason", reason).where("reason is not null")
    is_ = lambda r: c("reason") == r
    heavy = c("fallback_rate") >= 75
    tok = (
        F.when(is_("fallback_heavy"), F.greatest(F.when(heavy, _ceil_scale(c("p95_filtered_tokens"), 150, 100)).otherwise(_ceil_scale(c("p95_filtered_tokens"), 125, 100)), c("median_filtered_tokens") + 8, F.lit(24)))
        .when(is_("aggressive_compression"), F.greatest(_ceil_scale(c("p95_filtered_tokens"), 3, 2), F.floor(c("median_raw_tokens") / 6), F.lit(24)))
        .otherwise(F.greatest(_ceil_scale(c("p95_filtered_tokens"), 3, 4), F.lit(24)))
    )
    g = g.withColumn("max_tokens", tok.cast("bigint"))
    size = (
        F.when(is_("fallback_heavy"), F.greatest(F.when(heavy, _ceil_scale(c("p95_bytes_emitted"), 150, 100)).otherwise(_ceil_scale(c("p95_bytes_emitted"), 125, 100)), c("median_bytes_emitted") + 32, F.lit(96)))
        .when(is_("aggressive_compression"), F.greatest(_ceil_scale(c("p95_bytes_emitted"), 3, 2), c("max_tokens") * 4, F.lit(96)))
        .otherwise(F.greatest(_ceil_scale(c("p95_bytes_emitted"), 3, 4), F.lit(96)))
    )
    g = g.withColumn("max_bytes", size.cast("bigint"))
    severity = (
        F.when(is_("fallback_heavy"), c("fallback_rate") + c("failure_rate") / 4)
        .when(is_("aggressive_compression"), c("average_savings_pct") - 80 + c("median_raw_tokens") / 16)
        .otherwise(35 - c("average_savings_pct") + c("median_filtered_tokens") / 4)
    )
    g = g.withColumns(
        {
            "max_lines": F.least(F.greatest(_ceil_scale(c("max_bytes"), 1, 48), _ceil_scale(c("max_tokens"), 1, 12), F.lit(3)), F.lit(40)).cast("bigint"),
            "direction": F.when(is_("noisy"), "tighten").otherwise("loosen"),
            "scale": F.when(is_("noisy"), 0.75).when(is_("fallback_heavy") & ~heavy, 1.25).otherwise(1.5),
            "confidence": F.when(c("samples") >= 6, "high").when(c("samples") >= 4, "medium").otherwise("low"),
            "severity": F.round(severity, 4),
        }
    )
    out = g.join(prof, "command_fingerprint").withColumnRenamed("command_fingerprint", "fingerprint")
    return out.orderBy(F.desc("severity"), F.desc("samples"), "fingerprint").limit(limit) if limit else out


def retained(df: DataFrame, line: Column, max_bytes: int, retain: int = RETAIN_RECORDS) -> DataFrame:
    """``seq, kept``: what compaction keeps of a history file: the newest rows up to a number and a size.

    The newest row always stays. Only candidates (the ``retain`` newest, a bounded number) are summed in order; all
    others go.
    """
    sized = df.select("seq", (F.octet_length(line) + 1).alias("bytes"))
    newest = sized.orderBy(F.desc("seq")).limit(retain)
    w = Window.orderBy(F.desc("seq"))
    newest = newest.withColumn("rn", F.row_number().over(w)).withColumn("run", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = newest.where((F.col("rn") == 1) | (F.col("run") <= max_bytes)).select("seq", F.lit(True).alias("k"))
    return sized.select("seq").join(F.broadcast(keep), "seq", "left").select("seq", F.coalesce("k", F.lit(False)).alias("kept"))


def cost_report(df: DataFrame, rate_per_million: float = 3.0) -> DataFrame:
    """What the tokens that were saved would have cost, and how many context windows they fill."""
    return hydrate(df).agg(
        F.sum("saved_tokens").alias("saved_tokens"),
        (F.sum("saved_tokens") * F.lit(rate_per_million) / 1_000_000).alias("saved_cost"),
        (F.sum("saved_tokens") / F.lit(WINDOW_TOKENS)).alias("context_windows"),
    )


def recent(df: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs, hydrated."""
    return hydrate(df.orderBy(F.desc_nulls_last("timestamp"), F.desc("seq")).limit(limit))


def savings_ratio(df: DataFrame) -> DataFrame:
    """``profile, samples, ratio``: the part of tokens that a profile saves; few samples give 0.60; between 0 and 0.95."""
    h = hydrate(df).where("not passthrough and raw_tokens > 0")
    g = h.groupBy("profile").agg(F.count("*").alias("samples"), F.sum("saved_tokens").alias("saved"), F.sum("raw_tokens").alias("raw"))
    ratio = F.when(F.col("samples") < 3, 0.60).otherwise(F.least(F.greatest(F.col("saved") / F.col("raw"), F.lit(0.0)), F.lit(0.95)))
    return g.select("profile", "samples", ratio.alias("ratio"))
