"""What the history says about the way commands are run: hotspots by fingerprint, recommendations, what transcripts miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelore.operators import history as H

# Commands by family; the first word decides.
FAMILIES = {
    "git": ("git",), "go": ("go", "golangci-lint", "staticcheck"), "javascript": ("npm", "pnpm", "yarn", "bun", "npx", "node", "jest", "vitest", "tsc", "eslint"),
    "python": ("python", "python3", "pytest", "ruff", "mypy", "black", "pip", "uv"), "rust": ("cargo", "rustc"), "dotnet": ("dotnet",), "container": ("docker", "podman"),
    "kubernetes": ("kubectl", "helm"), "build": ("make", "cmake", "ninja", "bazel", "mvn", "gradle", "gradlew", "terraform", "tofu", "pulumi"),
    "search": ("rg", "grep", "find", "fd"), "files": ("ls", "tree", "cat", "head", "tail", "less", "bat"), "hosting": ("gh", "glab"), "cloud": ("aws", "gcloud", "az", "vercel", "heroku", "fly"),
    "data": ("jq", "psql", "sqlite3", "mysql", "duckdb"), "http": ("curl", "wget", "http"),
}


def family(command: Column) -> Column:
    """The family of a command's first word, ``other`` for unknown ones."""
    head = F.lower(F.element_at(H.words(command), 1))
    out = F.lit("other")
    for name, heads in FAMILIES.items():
        out = F.when(head.isin(*heads), name).otherwise(out)
    return out


def floor_percentile(h: DataFrame, key: str, value: str, p: float, name: str) -> DataFrame:
    """``key, name``: the value at place floor((n-1)*p) from 0 of each key. Values are counted first; of a key only distinct ones are ordered."""
    from pyspark.sql import Window

    v = h.groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    v = v.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("v")))
    return v.where(F.col("upto") > F.floor((F.col("total") - 1) * F.lit(p))).groupBy(key).agg(F.min("v").alias(name))


# Signals of a hotspot and what each adds to its coverage score; the least raw and filtered tokens of an average run (either
# is enough) and the saving in percent that it should reach. Fixed values.
SIGNAL_POINTS = {"repeated-passthrough": 2, "low-savings": 3, "fallback-heavy": 3, "tee-heavy": 2}
SAVING_TARGETS = ((512, 384, 30.0), (192, 144, 24.0), (72, 48, 20.0))


def workflow_hotspots(df: DataFrame) -> DataFrame:
    """One row a fingerprint over all runs: counts, rates, p50 and p95 of durations, signals, coverage score and severity."""
    h = H.hydrate(df).where("command_fingerprint <> ''")
    n, c = F.count("*"), F.col
    g = h.groupBy(F.col("command_fingerprint").alias("fingerprint")).agg(
        F.min_by("command", "seq").alias("command"), F.min_by("profile", "seq").alias("profile"), n.alias("runs"), (H.exact_sum("savings_pct") / n).alias("average_pct"),
        H.percent(F.count_if(c("exit_code") != 0), n).alias("failure_rate"), F.count_if(c("fallback_used")).alias("fallbacks"), H.percent(F.count_if(c("fallback_used")), n).alias("fallback_rate"),
        F.count_if(c("tee_path") != "").alias("tees"), H.percent(F.count_if(c("tee_path") != ""), n).alias("tee_rate"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("filtered_tokens").alias("residual"),
    )
    k = h.select(c("command_fingerprint").alias("fingerprint"), "duration_ms")
    for p, name in ((0.5, "p50_ms"), (0.95, "p95_ms")):
        g = g.join(floor_percentile(k, "fingerprint", "duration_ms", p, name), "fingerprint")
    generic = (c("profile") == "passthrough") | c("profile").startswith("generic-")
    raw, out = F.floor(c("raw_tokens") / c("runs")), F.floor(c("residual") / c("runs"))
    target = F.lit(None).cast("double")
    for least_raw, least_out, pct in reversed(SAVING_TARGETS):
        target = F.when((raw >= least_raw) | (out >= least_out), pct).otherwise(target)
    found = {
        "repeated-passthrough": generic & (c("runs") >= 3),
        "low-savings": (c("runs") >= 2) & (c("average_pct") < target),
        "fallback-heavy": (c("fallbacks") >= 2) & (c("fallback_rate") >= 50),
        "tee-heavy": (c("tees") >= 2) & (c("tee_rate") >= 50),
    }
    score = F.when(generic & (c("runs") >= 2), 1).otherwise(0) + F.least(F.greatest(c("runs") - 2, F.lit(0)), F.lit(4))
    for name, points in SIGNAL_POINTS.items():
        score = score + F.when(found[name], points).otherwise(0)
    g = g.withColumns({"signals": F.array_join(F.array_compact(F.array(*[F.when(v, F.lit(s)) for s, v in found.items()])), ","), "coverage": score.cast("int"), "family": family(c("command"))})
    severity = (100 - c("average_pct")) + c("fallback_rate") + c("failure_rate") / 2 + c("tee_rate") / 4 + c("p95_ms") / 25 + c("coverage") * 12
    return g.drop("fallbacks", "tees", "raw_tokens").withColumn("severity", F.round(severity, 4))


def recommendations(suggestions: DataFrame, hotspots: DataFrame) -> DataFrame:
    """``fingerprint, direction, reason, command, matched_by``: each budget suggestion with the hotspot that it is about.

    By fingerprint, else the hotspot of its family with most tokens left over (of equal ones the smallest fingerprint).
    Families are a fixed list, so the second side is small.
    """
    h = hotspots.select("fingerprint", F.col("command").alias("by_print"))
    top = hotspots.groupBy("family").agg(F.min_by("command", F.struct(-F.col("residual"), "fingerprint")).alias("by_family"))
    s = suggestions.select("fingerprint", "direction", "reason", family(F.col("command")).alias("family"))
    s = s.join(h, "fingerprint", "left").join(F.broadcast(top), "family", "left")
    by = F.when(F.col("by_print").isNotNull(), "fingerprint").when(F.col("by_family").isNotNull(), "family")
    return s.select("fingerprint", "direction", "reason", F.coalesce("by_print", "by_family").alias("command"), by.alias("matched_by"))


def suggestion_for(suggestions: DataFrame, fingerprint: str) -> DataFrame:
    """The suggestion for one command."""
    return suggestions.where(F.col("fingerprint") == fingerprint)


def missed_savings(outputs: DataFrame, ratios: DataFrame, least_bytes: int = 200) -> DataFrame:
    """``command, n, raw_tokens, missed``: outputs that weren't reduced, by command, and what the ratio of its profile would have saved.

    ``outputs``: ``command, profile, raw_tokens, raw_bytes``; outputs under ``least_bytes`` are trivial. A profile without history
    has the ratio 0.6. ``missed`` of each output is rounded half up before it is added.
    """
    o = outputs.where(F.col("raw_bytes") >= least_bytes).join(F.broadcast(ratios.select("profile", "ratio")), "profile", "left")
    miss = F.floor(F.col("raw_tokens") * F.coalesce("ratio", F.lit(0.6)) + 0.5)
    return o.groupBy(H.command_key(F.col("command")).alias("command")).agg(F.count("*").alias("n"), F.sum("raw_tokens").alias("raw_tokens"), F.sum(miss).cast("bigint").alias("missed"))


def with_total(groups: DataFrame, label: str, most: int) -> DataFrame:
    """The largest groups by ``missed``, and a row with the totals of all groups."""
    top = groups.orderBy(F.desc("missed"), label).limit(most)
    rest = [c for c in groups.columns if c != label]
    return top.unionByName(groups.agg(F.lit("total").alias(label), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rest]))
