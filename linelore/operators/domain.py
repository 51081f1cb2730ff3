"""Outputs that are lists of things (layers, checks, entries, tests) as rows: the last state of each thing counts.

What a render shows of them is in ``linelore.reducers``; here they are tables for analysis over many outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelore.functions import text as T


def tool_lines(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id, line_no, line``: trimmed lines without colour codes that aren't blank."""
    src = df.select(F.col(record_id).alias("record_id"), F.posexplode(F.split(F.regexp_replace(T.strip_ansi(F.col(text)), "\r", ""), "\n")).alias("p", "raw"))
    return src.select("record_id", (F.col("p") + 1).alias("line_no"), T.rtrim(F.col("raw")).alias("line")).where("line <> ''")


def last_states(lines: DataFrame, pattern: str) -> DataFrame:
    """``record_id, thing, state, updates, first_line``: group 1 of the pattern names a thing, group 2 says its state; the last one counts."""
    m = lines.where(F.col("line").rlike(pattern)).select("record_id", "line_no", F.regexp_extract("line", pattern, 1).alias("thing"), F.regexp_extract("line", pattern, 2).alias("state"))
    return m.groupBy("record_id", "thing").agg(F.max_by("state", "line_no").alias("state"), (F.count("*") - 1).alias("updates"), F.min("line_no").alias("first_line"))


LAYER = r"^(?:\[[0-9:]+\] )?(?:layer )?([0-9a-f]{8,12})(?::)? (Pull complete|Already exists|already exists|Pushed|Waiting|Downloading|Extracting|Verifying Checksum|Download complete|Layer already exists)"
ROLLOUT = r"^(?:\[[0-9:]+\] )?(?:Waiting for )?deployment \"([^\"]+)\" (rollout to finish: .*|successfully rolled out)"
CHECK = r"^(?:\[[0-9:]+\] )?(\S+): check (pending|pass|passed|fail|failed|skipped|cancelled|queued)"
COMPOSE = r"^\s*(?:Container|Network|Volume)\s+(\S+)\s+(Creating|Created|Starting|Started|Healthy|Waiting|Stopping|Stopped|Removed|Error)"
# Words and signs by which lists of checks say one of six states; the first that is found counts. Fixed values.
CHECK_STATES = (("fail", "fail|failed|failure|error|timed_out|✗|x|X"), ("cancelled", "cancelled|canceled"), ("pending", "pending|queued|in_progress|waiting|\\*"), ("skipped", "skipped|skipping|neutral|-"), ("pass", "pass|passed|success|✓"))


def check_state(word: Column) -> Column:
    out = F.lit("unknown")
    for name, words in reversed(CHECK_STATES):
        out = F.when(F.lower(word).rlike(f"^(?:{words})$"), name).otherwise(out)
    return out


def check_rows(lines: DataFrame) -> DataFrame:
    """Checks of pull requests, ``name<tab>state<tab>...``; the last row of a check counts."""
    cells = F.split("line", "\t")
    m = lines.where(F.size(cells) >= 2).select("record_id", "line_no", T.trim(F.get(cells, F.lit(0))).alias("name"), check_state(T.trim(F.get(cells, F.lit(1)))).alias("state"))
    return m.groupBy("record_id", "name").agg(F.max_by("state", "line_no").alias("state"), (F.count("*") - 1).alias("updates"), F.min("line_no").alias("first_line"))


def status_counts(lines: DataFrame) -> DataFrame:
    """Staged, changed and untracked entries of short status listings, and the branch."""
    x, y = F.substring("line", 1, 1), F.substring("line", 2, 1)
    is_entry = F.col("line").rlike(r"^[MADRCUT?! ][MADRCUT?! ] +\S") & ~F.col("line").startswith("## ") & F.col("line").rlike(r"^(?! {2})")
    e = lines.where(is_entry | F.col("line").startswith("## "))
    return e.groupBy("record_id").agg(
        F.count_if(is_entry & x.isin(*"MADRCUT")).alias("staged"),
        F.count_if(is_entry & y.isin(*"MADRCUT")).alias("unstaged"),
        F.count_if(is_entry & (x == "?")).alias("untracked"),
        F.coalesce(F.max(F.when(F.col("line").startswith("## "), F.substring("line", 4, 200))), F.lit("")).alias("branch"),
    )


def commits(lines: DataFrame) -> DataFrame:
    """``record_id, first_line, subject, n``: one-line logs, equal subjects in a row folded."""
    from pyspark.sql import Window

    c = lines.where(F.col("line").rlike(r"^[0-9a-f]{7,40} \S")).select("record_id", "line_no", F.regexp_extract("line", r"^[0-9a-f]{7,40} (?:\([^)]*\) )?(.*)$", 1).alias("subject"))
    w = Window.partitionBy("record_id").orderBy("line_no")  # one text's lines
    c = c.withColumn("s", F.coalesce((F.col("subject") != F.lag("subject").over(w)), F.lit(True)).cast("int")).withColumn("g", F.sum("s").over(w))
    return c.groupBy("record_id", "g").agg(F.min("line_no").alias("first_line"), F.first("subject").alias("subject"), F.count("*").alias("n")).drop("g")


TEST = r"^(?:\[[0-9:]+\] )?\s*(?:--- )?(FAIL|PASS|SKIP|ok):? +([^ (]+)(?: +\(([0-9.]+) ?s\))?"


def test_results(lines: DataFrame) -> DataFrame:
    """``record_id, passed, failed, failing``: outcomes of tests and the first four that fail, in order."""
    m = lines.where(F.col("line").rlike(TEST)).select("record_id", "line_no", F.regexp_extract("line", TEST, 1).alias("o"), F.regexp_extract("line", TEST, 2).alias("t"))
    bad = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("o") == "FAIL", F.struct("line_no", "t")))), lambda x: x["t"]))
    return m.groupBy("record_id").agg(F.count_if(F.col("o").isin("PASS", "ok")).alias("passed"), F.count_if(F.col("o") == "FAIL").alias("failed"), F.array_join(F.slice(bad, 1, 4), ", ").alias("failing"))


def test_events(lines: DataFrame) -> DataFrame:
    """Test events written as JSON lines: the outcome of each package and up to four of its failing tests."""
    j = F.from_json("line", "Action string, Package string, Test string, Elapsed double")
    e = lines.where(F.col("line").startswith("{")).select("record_id", "line_no", j.alias("j")).where("j.Package is not null")
    bad = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when((F.col("j.Action") == "fail") & F.col("j.Test").isNotNull(), F.struct("line_no", F.col("j.Test").alias("t"))))), lambda x: x["t"]))
    whole = F.col("j.Test").isNull() & F.col("j.Action").isin("pass", "fail", "skip")
    return e.groupBy("record_id", F.col("j.Package").alias("package")).agg(F.max_by("j.Action", F.when(whole, F.col("line_no"))).alias("outcome"), F.slice(bad, 1, 4).alias("failing"))


def listing(lines: DataFrame) -> DataFrame:
    """``record_id, dirs, files, hidden``: entries of a long directory listing."""
    p = r"^(?:\[[0-9:]+\] )?([d-])[rwxsStT-]{9}\S*\s"
    m = lines.where(F.col("line").rlike(p)).select("record_id", F.regexp_extract("line", p, 1).alias("k"), F.regexp_extract("line", r"(\S+)$", 1).alias("name"))
    return m.groupBy("record_id").agg(F.count_if(F.col("k") == "d").alias("dirs"), F.count_if(F.col("k") == "-").alias("files"), F.count_if(F.col("name").startswith(".")).alias("hidden"))


def applied(lines: DataFrame) -> DataFrame:
    """``record_id, verb, n, sample``: objects that were created, configured, left or deleted, three names each."""
    p = r"^(\S+/\S+) (created|configured|unchanged|deleted|patched|pruned)(?: \(.*\))?$"
    m = lines.where(F.col("line").rlike(p)).select("record_id", "line_no", F.regexp_extract("line", p, 1).alias("o"), F.regexp_extract("line", p, 2).alias("verb"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "o"))), lambda x: x["o"])
    return m.groupBy("record_id", "verb").agg(F.count("*").alias("n"), F.slice(names, 1, 3).alias("sample"))


def containers(lines: DataFrame) -> DataFrame:
    """``record_id, running, exited, other``: states in a listing of containers."""
    s = F.when(F.col("line").rlike(r"\bUp \d|\bUp (?:About|Less)"), "running").when(F.col("line").rlike(r"\bExited \("), "exited").when(F.col("line").rlike(r"\b(?:Created|Restarting|Paused|Dead)\b"), "other")
    m = lines.withColumn("s", s).where("s is not null")
    return m.groupBy("record_id").agg(*[F.count_if(F.col("s") == k).alias(k) for k in ("running", "exited", "other")])


def images(lines: DataFrame) -> DataFrame:
    """``record_id, images, dangling, megabytes``: a listing of images with its total size."""
    p = r"^(\S+)\s+(\S+)\s+[0-9a-f]{12}\s.*?([0-9.]+)(kB|KB|MB|GB)$"
    unit = F.when(F.regexp_extract("line", p, 4) == "GB", 1000.0).when(F.regexp_extract("line", p, 4) == "MB", 1.0).otherwise(0.001)
    m = lines.where(F.col("line").rlike(p)).select("record_id", F.regexp_extract("line", p, 1).alias("repo"), (F.regexp_extract("line", p, 3).cast("double") * unit).alias("mb"))
    return m.groupBy("record_id").agg(F.count("*").alias("images"), F.count_if(F.col("repo") == "<none>").alias("dangling"), F.round(F.sum("mb"), 3).alias("megabytes"))


def environment(lines: DataFrame) -> DataFrame:
    """``record_id, prefix, n, names``: variables by the part of their name before the first ``_`` (two and more), secrets redacted."""
    p = r"^([A-Za-z_][A-Za-z0-9_]*)=(.*)$"
    name, value = F.regexp_extract("line", p, 1), F.regexp_extract("line", p, 2)
    m = lines.where(F.col("line").rlike(p)).select("record_id", name.alias("name"), T.redact(name, value).alias("value"), F.when(name.contains("_"), F.substring_index(name, "_", 1)).otherwise(name).alias("prefix"))
    return m.groupBy("record_id", "prefix").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws("=", "name", "value"))).alias("names"))


def pipelines(lines: DataFrame) -> DataFrame:
    """``(status) • detail`` rows: the statuses of each text, how often each occurs and whether it is the dominant one (of equal ones the first seen)."""
    p = r"^\((\w+)\) [•·] (.*)$"
    m = lines.where(F.col("line").rlike(p)).select("record_id", "line_no", F.regexp_extract("line", p, 1).alias("status"))
    g = m.groupBy("record_id", "status").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))
    top = g.groupBy("record_id").agg(F.min_by("status", F.struct(-F.col("n"), "first_line")).alias("top"))
    return g.join(top, "record_id").select("record_id", "status", "n", (F.col("status") == F.col("top")).alias("dominant"))
