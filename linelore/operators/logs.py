"""Reductions of log lines: severities, deduplicated messages, priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linelore.functions import text as T

CLOCK = r"([0-9]{2}:[0-9]{2}:[0-9]{2})"


def log_lines(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id, line_no, line, severity, key, clock`` of the lines that aren't blank, without colour codes."""
    src = df.select(F.col(record_id).alias("record_id"), F.posexplode(F.split(F.regexp_replace(T.strip_ansi(F.col(text)), "\r", ""), "\n")).alias("pos", "raw"))
    src = src.select("record_id", (F.col("pos") + 1).alias("line_no"), T.trim(F.col("raw")).alias("line")).where("line <> ''")
    # the words of a line are made once, for its severity and its key
    src = src.select("*", T.severity_and_key(F.col("line")).alias("f"), F.regexp_extract("line", CLOCK, 1).alias("clock"))
    return src.select("record_id", "line_no", "line", "f.severity", "f.key", "clock")


def severity_histogram(lines: DataFrame) -> DataFrame:
    return lines.groupBy("severity").agg(F.count("*").alias("n"))


def message_groups(lines: DataFrame, most: int = 240) -> DataFrame:
    """Distinct messages of each text with their count and the clock times of the first and last line that has one."""
    at = lambda f: f("clock", F.when(F.col("clock") != "", F.col("line_no")))
    g = lines.groupBy("record_id", "severity", "key").agg(F.count("*").alias("n"), F.min_by("line", "line_no").alias("line"), F.min("line_no").alias("first_line"), at(F.min_by).alias("first_clock"), at(F.max_by).alias("last_clock"))
    return g.select("record_id", "severity", "key", "n", T.clip(F.col("line"), most).alias("display"), "first_line", F.coalesce("first_clock", F.lit("")).alias("first_clock"), F.coalesce("last_clock", F.lit("")).alias("last_clock"))


def prioritised(lines: DataFrame, most: int = 20) -> DataFrame:
    """The messages of each text that fit a number of lines: errors, then anchors, hints, others, boilerplate; in stream order."""
    k = lines.withColumn("kind", T.log_kind(F.col("line")))
    g = k.groupBy("record_id", "key").agg(F.count("*").alias("n"), F.min_by("line", "line_no").alias("line"), F.min("line_no").alias("first_line"), F.max("kind").alias("kind"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in {4: 0, 3: 1, 2: 2, 0: 3, 1: 4}.items() for x in kv]), F.col("kind"))
    w = Window.partitionBy("record_id").orderBy(rank, "first_line")
    kept = g.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return kept.select("record_id", "first_line", "kind", "n", F.when(F.col("n") > 1, F.concat("line", F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("line")).alias("line"))


def looks_like_log(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id, is_log``: whether most of a text's first forty lines begin with a time or a level (at least five lines)."""
    from linelore.operators.lines import reducer_lines

    d = df.select(F.col(record_id).alias("record_id"), F.slice(reducer_lines(F.col(text)), 1, 40).alias("ls"))
    level = r"^[\[(<]?(?i:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|ERR|FATAL|PANIC|CRITICAL|CRIT)[\])>:]?(?:\s|$)"
    timed = lambda x: T.let(T.collapse(F.concat(x, F.lit(" x"))), lambda y: T.similar_line_key(y) != y)
    shaped = F.filter("ls", lambda x: x.rlike(level) | x.rlike(r"^\s*[0-9]{4}[-/][0-9]{2}[-/][0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}") | timed(x))
    return d.select("record_id", ((F.size("ls") >= 5) & (F.size(shaped) * 2 > F.size("ls"))).alias("is_log"))


def failure_items(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """Root causes, frames, hints and warnings of failing runs: one row per distinct item, with the number of similar lines."""
    src = df.select(F.col(record_id).alias("record_id"), F.posexplode(F.split(F.regexp_replace(T.strip_ansi(F.col(text)), "\r", ""), "\n")).alias("pos", "raw"))
    src = src.select("record_id", (F.col("pos") + 1).alias("line_no"), T.trim(F.col("raw")).alias("line")).where("line <> ''").where(T.failure_noise(F.col("line")) == "")
    src = src.withColumns({"kind": T.failure_kind(F.col("line")), "anchor": T.anchor(F.col("line"))}).where("kind <> ''")
    key = F.lower(F.when((F.col("anchor") != "") & (F.col("kind") != "hint"), F.col("anchor")).otherwise(F.col("line")))
    return src.groupBy("record_id", "kind", key.alias("key")).agg(F.min("line_no").alias("line_no"), F.min_by(T.clip(F.col("line"), 160), "line_no").alias("line"), (F.count("*") - 1).alias("similar"))


def failure_summary(items: DataFrame, most: int = 12) -> DataFrame:
    """The items that fit: half for root causes, a third each for frames and hints, warnings in what is left."""
    order = F.when(F.col("kind") == "root", 0).when(F.col("kind") == "stack", 1).when(F.col("kind") == "hint", 2).otherwise(3)
    w = Window.partitionBy("record_id", "kind").orderBy("line_no")
    quota = F.when(F.col("kind") == "root", most // 2 + 1).when(F.col("kind").isin("stack", "hint"), max(1, most // 3)).otherwise(most)
    kept = items.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= quota)
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("record_id").orderBy(order, "line_no"))).where(F.col("place") <= most)
    what = F.when(F.col("kind") == "stack", "frames").when(F.col("kind") == "hint", "hints").when(F.col("kind") == "warning", "warnings").otherwise("lines")
    return kept.select("record_id", "place", "kind", F.when(F.col("similar") > 0, F.format_string("%s (+%d similar %s)", F.col("line"), F.col("similar"), what)).otherwise(F.col("line")).alias("line"))


def source_messages(entries: DataFrame) -> DataFrame:
    """``component, template, n``: messages of each source with digits and hexadecimal words masked."""
    return entries.groupBy("component", T.template_key(F.col("message")).alias("template")).agg(F.count("*").alias("n"))


def stream_messages(lines: DataFrame) -> DataFrame:
    """``record_id, source, message, n, first_line``: lines behind the label of their stream (``name-1 | ``), by message; ``log`` without one."""
    label = r"^([A-Za-z][\w.-]*-[0-9]+) +\| ?"
    source = F.regexp_extract("line", label, 1)
    m = lines.select("record_id", "line_no", F.when(source == "", "log").otherwise(source).alias("source"), T.template_key(F.regexp_replace("line", label, "")).alias("message"))
    return m.groupBy("record_id", "source", "message").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def event_stats(events: DataFrame, source: str, stamp: str, kind: str) -> DataFrame:
    """``kind, n, sources, first, last``: events of each kind, how many sources they have, and their first and last written time."""
    return events.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct(source).alias("sources"), F.min(F.col(stamp).cast("string")).alias("first"), F.max(F.col(stamp).cast("string")).alias("last"))


def template_groups(lines: DataFrame) -> DataFrame:
    """``template, n, severity``: the templates of all lines; severity is the worst that occurs."""
    order = F.create_map(*[F.lit(x) for kv in (("FATAL", 0), ("ERROR", 1), ("WARN", 2), ("INFO", 3), ("DEBUG", 4), ("TRACE", 5), ("other", 6)) for x in kv])
    return lines.groupBy(T.template_key(F.col("line")).alias("template")).agg(F.count("*").alias("n"), F.min_by("severity", F.element_at(order, F.col("severity"))).alias("severity"))
