"""Billed usage of agent transcripts, and which session each run belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linelore.operators.intervals import containing

COUNTERS = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")
RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$"
SLACK_S = 120


def project(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def session_id(path: Column) -> Column:
    """``<project>/<session>.jsonl`` or ``<project>/<session>/.../agent-<id>.jsonl``."""
    return F.regexp_replace(F.get(F.split(path, "/"), F.lit(1)), r"\.jsonl$", "")


def agent_id(path: Column) -> Column:
    """Empty for a session's own transcript."""
    parts = F.split(path, "/")
    base = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "")
    short = F.regexp_replace(base, "^agent-", "")
    return F.when(F.size(parts) <= 2, "").when(short == "", base).otherwise(short)


def moment(c: Column) -> Column:
    return F.when(c.rlike(RFC3339), c.try_cast("timestamp"))


def last_payloads(lines: DataFrame) -> DataFrame:
    """The last usage of each message of a file; a message without ids is one of its own."""
    used = lines.where("type = 'assistant'").where(F.coalesce(*[F.col(c) for c in COUNTERS]).isNotNull())
    key = F.when(F.coalesce("message_id", F.lit("")) != "", F.col("message_id")).when(F.coalesce("uuid", F.lit("")) != "", F.concat(F.lit("uuid:"), "uuid")).otherwise(F.concat(F.lit("synthetic:"), F.col("line_id").cast("string")))
    last = F.max_by(F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COUNTERS]), F.struct("line_no", "line_id")).alias("u")
    return used.groupBy("file_path", key.alias("turn")).agg(last).select("file_path", "turn", "u.*")


def sessions(lines: DataFrame) -> DataFrame:
    """One row per session with usage: times, directory, turns and counters, those of its own transcript, and its agents."""
    path = F.col("file_path")
    per_file = last_payloads(lines).groupBy("file_path").agg(F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in COUNTERS])
    who = {"project": project(path), "session_id": session_id(path), "agent_id": agent_id(path)}
    per_agent = per_file.withColumns(who).groupBy("project", "session_id", "agent_id").agg(*[F.sum(c).alias(c) for c in ("turns", *COUNTERS)])
    own = F.col("agent_id") == ""
    agents = F.array_sort(F.collect_list(F.when(~own, F.struct("agent_id", "turns", "output_tokens"))))
    sums = per_agent.groupBy("project", "session_id").agg(*[F.sum(c).alias(c) for c in ("turns", *COUNTERS)], F.coalesce(F.sum(F.when(own, F.col("turns"))), F.lit(0)).alias("main_turns"), F.count_if(~own).alias("agent_count"), agents.alias("agents"))
    t = moment(F.col("timestamp"))
    seen = lines.groupBy(project(path).alias("project"), session_id(path).alias("session_id")).agg(
        F.min(t).alias("first_seen"),
        F.max(t).alias("last_seen"),
        F.coalesce(F.min_by("cwd", F.when(F.coalesce("cwd", F.lit("")) != "", F.struct("file_path", "line_no", "line_id"))), F.lit("")).alias("cwd"),
        F.countDistinct("file_path").alias("transcript_files"),
    )
    return sums.join(seen, ["project", "session_id"])


def attribute(sessions_: DataFrame, history: DataFrame, shard_s: int = 86_400) -> DataFrame:
    """``seq, session_id, by_scope, ambiguous``: the session that each run belongs to.

    By its scope, if that is a session's id; else by directory and time (two minutes of slack): the session that began
    last. Times are looked up in the sessions' step function, shard by shard, so a run costs the same however many
    sessions overlap. Runs without match are left out.
    """
    h = history.select("seq", F.col("session_scope").alias("scope"), "cwd", F.col("timestamp").alias("t"))
    known = sessions_.select(F.col("session_id").alias("scope"), F.lit(True).alias("known")).distinct()
    h = h.join(known, "scope", "left")
    direct = h.where("known").select("seq", F.col("scope").alias("session_id"), F.lit(True).alias("by_scope"), F.lit(False).alias("ambiguous"))
    r, s = h.where("known is null and cwd <> ''"), sessions_.where("cwd <> ''")
    c = F.col
    found = containing(r, (c("seq"), c("cwd"), c("t")), s, (c("session_id"), c("cwd"), c("first_seen"), c("last_seen")), SLACK_S, shard_s)
    return direct.unionByName(found.select(c("record_id").alias("seq"), c("interval_id").alias("session_id"), F.lit(False).alias("by_scope"), (c("n") > 1).alias("ambiguous")))


def report(sessions_: DataFrame, history: DataFrame) -> DataFrame:
    """Sessions with the runs that belong to them and their tokens as a part of the fresh input."""
    a = attribute(sessions_, history).join(history.select("seq", "filtered_tokens", "saved_tokens"), "seq")
    g = a.groupBy("session_id").agg(F.count("*").alias("runs"), F.sum("filtered_tokens").alias("emitted_tokens"), F.sum("saved_tokens").alias("avoided_tokens"), F.count_if("ambiguous").alias("ambiguous_runs"))
    fresh = F.col("input_tokens") + F.col("cache_creation_input_tokens")
    out = sessions_.join(g, "session_id", "left").withColumn("fresh_input_tokens", fresh)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    pct = lambda c: F.when(F.col("fresh_input_tokens") > 0, zero(c) * 100.0 / F.col("fresh_input_tokens")).otherwise(0.0)
    return out.select("project", "session_id", "turns", "fresh_input_tokens", "output_tokens", *[zero(c).alias(c) for c in ("runs", "emitted_tokens", "avoided_tokens", "ambiguous_runs")], pct("emitted_tokens").alias("emitted_pct"), pct("avoided_tokens").alias("avoided_pct"))


def tool_pairs(blocks: DataFrame) -> DataFrame:
    """Each result with the use that it answers: the last use of its id before it in the file, each use once.

    ``blocks``: ``file, seq, kind`` (use or result), ``id, payload``. Results without a use before them are left out.
    """
    w = Window.partitionBy("file", "id").orderBy("seq")
    prev = F.lag(F.struct("kind", "payload", "seq")).over(w)
    p = blocks.withColumn("p", prev).where("kind = 'result' and p.kind = 'use'")
    return p.select("file", "id", F.col("p.seq").alias("use_seq"), F.col("seq").alias("result_seq"), F.col("p.payload").alias("use"), F.col("payload").alias("result"))
