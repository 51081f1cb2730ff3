"""Queries that join runs, transcripts and stored outputs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from linelore.functions.fingerprint import fingerprint
from linelore.operators import dedup as D
from linelore.operators import usage as U
from linelore.plans.history import FP
from linelore.session import table


def usage_last_payload_wins(spark, root):
    return U.last_payloads(table(spark, root, "usage_lines"))


def usage_session_rollup(spark, root):
    return U.sessions(table(spark, root, "usage_lines")).drop("agents")


def usage_agents(spark, root):
    s = U.sessions(table(spark, root, "usage_lines"))
    return s.select("session_id", F.explode("agents").alias("a")).select("session_id", "a.*")


def _sessions(spark, root):
    s = table(spark, root, "session_usage")
    s = s.select("session_id", "project", F.coalesce("cwd", F.lit("")).alias("cwd"), F.col("first_seen").cast("timestamp").alias("first_seen"), F.col("last_seen").cast("timestamp").alias("last_seen"), "turns", "input_tokens", F.col("cache_creation_tokens").alias("cache_creation_input_tokens"), "output_tokens")
    best = F.max(F.struct("last_seen", "first_seen", "cwd", "turns", "input_tokens", "cache_creation_input_tokens", "output_tokens", "project")).alias("s")
    return s.groupBy("session_id").agg(best).select("session_id", "s.*")


def usage_window_attribution(spark, root):
    return U.attribute(_sessions(spark, root), table(spark, root, "history"))


def usage_report(spark, root):
    return U.report(_sessions(spark, root), table(spark, root, "history"))


def _runs(spark, root):
    c = table(spark, root, "captures")
    text = F.coalesce("raw_combined", F.lit(""))
    return c.select(F.col("capture_id").alias("id"), F.col("captured_at").alias("ts"), fingerprint(F.array_join("command", " ")).alias("fingerprint"), "cwd", "exit_code", D.content_hash(text).alias("raw_hash"))


def dedup_exact_window(spark, root):
    return D.exact_repeats(_runs(spark, root), 7 * 86_400)


def delta_baseline_asof(spark, root):
    return D.delta_baselines(_runs(spark, root), 7 * 86_400)


def content_hash_duplicates(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    return d.groupBy(D.reference(D.content_hash(F.col("text"))).alias("ref")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")


def multiset_line_diff(spark, root):
    p = D.delta_baselines(_runs(spark, root), 30 * 86_400)
    c = table(spark, root, "captures").select("capture_id", "raw_combined")
    p = p.join(c.select(F.col("capture_id").alias("id"), F.col("raw_combined").alias("new")), "id").join(c.select(F.col("capture_id").alias("prev_id"), F.col("raw_combined").alias("old")), "prev_id")
    return D.line_diff(p, "old", "new")


def orphan_artifacts_anti(spark, root):
    return D.orphans(table(spark, root, "documents").select("doc_id"), table(spark, root, "subject_labels"), "doc_id")


def _hints(spark, root):
    h = table(spark, root, "history").where("timestamp is not null")
    wide = h.groupBy("profile").agg(F.max("timestamp").alias("expires_at")).select(F.col("profile").alias("hint_id"), "profile", F.lit(None).cast("string").alias("fingerprint"), "expires_at")
    fine = h.where("command_fingerprint is not null").groupBy("profile", "command_fingerprint").agg(F.max("timestamp").alias("expires_at"), F.count("*").alias("n")).where("n >= 50")
    return wide.unionByName(fine.select(F.concat_ws(":", "profile", "command_fingerprint").alias("hint_id"), "profile", F.col("command_fingerprint").alias("fingerprint"), "expires_at"))


def _hinted(spark, root):
    h = table(spark, root, "history").where("timestamp is not null").select(F.col("seq").alias("id"), "profile", F.col("command_fingerprint").alias("fingerprint"), F.col("timestamp").alias("ts"), "exit_code")
    return h


def hint_lookup(spark, root):
    return D.hint_lookup(_hinted(spark, root), _hints(spark, root))


def hint_rollback(spark, root):
    h = _hinted(spark, root)
    used = D.hint_lookup(h, _hints(spark, root)).join(h.select("id", "exit_code"), "id")
    return D.hint_rollback(used.select("hint_id", (F.col("exit_code") != 0).alias("harmful")))


_LIST = (usage_last_payload_wins, usage_session_rollup, usage_agents, usage_window_attribution, usage_report, dedup_exact_window, delta_baseline_asof, content_hash_duplicates, multiset_line_diff, orphan_artifacts_anti, hint_lookup, hint_rollback)
QUERIES = {f.__name__: f for f in _LIST}

_LAST = """SELECT file_path, CASE WHEN coalesce(message_id, '') <> '' THEN message_id WHEN coalesce(uuid, '') <> '' THEN 'uuid:' || uuid ELSE 'synthetic:' || line_id END AS turn,
  coalesce(input_tokens, 0) AS input_tokens, coalesce(cache_creation_input_tokens, 0) AS cache_creation_input_tokens, coalesce(cache_read_input_tokens, 0) AS cache_read_input_tokens, coalesce(output_tokens, 0) AS output_tokens
FROM usage_lines WHERE type = 'assistant' AND coalesce(input_tokens, cache_creation_input_tokens, cache_read_input_tokens, output_tokens) IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY file_path, turn ORDER BY line_no DESC, line_id DESC) = 1"""
_WHO = "split_part(file_path, '/', 1) AS project, regexp_replace(split_part(file_path, '/', 2), '\\.jsonl$', '') AS session_id"
_AGENT = "CASE WHEN len(string_split(file_path, '/')) <= 2 THEN '' ELSE regexp_replace(regexp_replace(string_split(file_path, '/')[-1], '\\.jsonl$', ''), '^agent-', '') END AS agent_id"
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in U.COUNTERS)
_TS = "CASE WHEN regexp_matches(\"timestamp\", '^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)$') THEN TRY_CAST(regexp_replace(\"timestamp\", '(\\.\\d{6})\\d+', '\\1') AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END"
_ROLL = f"""u AS ({_LAST}), a AS (SELECT {_WHO}, {_AGENT}, count(*) AS turns, {_SUMS} FROM u GROUP BY ALL)"""
_CUR = """cur AS (SELECT session_id, project, coalesce(cwd, '') AS cwd, first_seen, last_seen, turns, input_tokens, cache_creation_tokens, output_tokens FROM session_usage
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY last_seen DESC, first_seen DESC, coalesce(cwd, '') DESC, turns DESC, input_tokens DESC, cache_creation_tokens DESC, output_tokens DESC, project DESC) = 1)"""
_ATTR = _CUR + """, d AS (SELECT h.seq, c.session_id, true AS by_scope, false AS ambiguous FROM history h JOIN cur c ON h.session_scope = c.session_id),
m AS (SELECT h.seq, c.session_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY h.seq) > 1 AS ambiguous FROM history h JOIN cur c ON h.cwd = c.cwd AND c.cwd <> '' AND h."timestamp" >= c.first_seen - INTERVAL 2 MINUTE AND h."timestamp" <= c.last_seen + INTERVAL 2 MINUTE
  WHERE h.seq NOT IN (SELECT seq FROM d) WINDOW w AS (PARTITION BY h.seq ORDER BY c.first_seen DESC, c.last_seen DESC, c.session_id)),
a AS (SELECT * FROM d UNION ALL SELECT seq, session_id, false, ambiguous FROM m WHERE rn = 1)"""
_CAPFP = FP.replace("command", "array_to_string(command, ' ')")
_RUNS = f"runs AS (SELECT capture_id AS id, captured_at AS ts, {_CAPFP} AS fp, cwd, exit_code, sha256(coalesce(raw_combined, '')) AS raw_hash FROM captures)"
_BASE = _RUNS + """, b AS (SELECT *, lag(id) OVER w AS prev_id, lag(ts) OVER w AS prev_ts, lag(exit_code) OVER w AS pe, lag(raw_hash) OVER w AS ph FROM runs WINDOW w AS (PARTITION BY fp, cwd ORDER BY ts, id))"""
_HINTS = """hints AS (SELECT profile AS hint_id, profile, NULL AS fp, max("timestamp") AS expires_at FROM history WHERE "timestamp" IS NOT NULL GROUP BY profile
 UNION ALL SELECT profile || ':' || command_fingerprint, profile, command_fingerprint, max("timestamp") FROM history WHERE "timestamp" IS NOT NULL AND command_fingerprint IS NOT NULL GROUP BY profile, command_fingerprint HAVING count(*) >= 50),
l AS (SELECT h.seq AS id, x.hint_id, h.exit_code FROM history h JOIN hints x ON h.profile = x.profile AND h."timestamp" < x.expires_at AND (x.fp IS NULL OR x.fp = h.command_fingerprint)
 QUALIFY row_number() OVER (PARTITION BY h.seq ORDER BY x.fp IS NULL, x.expires_at DESC, x.hint_id) = 1)"""
SQL = {
    "usage_last_payload_wins": _LAST,
    "usage_session_rollup": f"""WITH {_ROLL}, s AS (SELECT project, session_id, sum(turns)::BIGINT AS turns, {_SUMS}, coalesce(sum(turns) FILTER (WHERE agent_id = ''), 0)::BIGINT AS main_turns, count_if(agent_id <> '') AS agent_count FROM a GROUP BY ALL),
l AS (SELECT {_WHO}, min({_TS}) AS first_seen, max({_TS}) AS last_seen, coalesce(arg_min(cwd, (file_path, line_no, line_id)) FILTER (WHERE coalesce(cwd, '') <> ''), '') AS cwd, count(DISTINCT file_path) AS transcript_files FROM usage_lines GROUP BY ALL)
SELECT * FROM s JOIN l USING (project, session_id)""",
    "usage_agents": f"WITH {_ROLL} SELECT session_id, agent_id, sum(turns)::BIGINT AS turns, sum(output_tokens)::BIGINT AS output_tokens FROM a WHERE agent_id <> '' GROUP BY project, session_id, agent_id",
    "usage_window_attribution": f"WITH {_ATTR} SELECT * FROM a",
    "usage_report": f"""WITH {_ATTR}, g AS (SELECT a.session_id, count(*) AS runs, sum(h.filtered_tokens)::BIGINT AS e, sum(h.saved_tokens)::BIGINT AS v, count_if(ambiguous) AS amb FROM a JOIN history h USING (seq) GROUP BY a.session_id)
SELECT project, session_id, turns, input_tokens + cache_creation_tokens AS fresh_input_tokens, output_tokens, coalesce(runs, 0) AS runs, coalesce(e, 0) AS emitted_tokens, coalesce(v, 0) AS avoided_tokens, coalesce(amb, 0) AS ambiguous_runs,
 CASE WHEN input_tokens + cache_creation_tokens > 0 THEN coalesce(e, 0) * 100.0::DOUBLE / (input_tokens + cache_creation_tokens) ELSE 0 END AS emitted_pct,
 CASE WHEN input_tokens + cache_creation_tokens > 0 THEN coalesce(v, 0) * 100.0::DOUBLE / (input_tokens + cache_creation_tokens) ELSE 0 END AS avoided_pct FROM cur LEFT JOIN g USING (session_id)""",
    "dedup_exact_window": f"WITH {_RUNS}, b AS (SELECT *, lag(id) OVER w AS prev_id, lag(ts) OVER w AS prev_ts FROM runs WINDOW w AS (PARTITION BY fp, cwd, exit_code, raw_hash ORDER BY ts, id)) SELECT id, prev_id, left(raw_hash, 12) AS ref FROM b WHERE ts - prev_ts <= INTERVAL 7 DAY",
    "delta_baseline_asof": f"WITH {_BASE} SELECT id, prev_id FROM b WHERE ts - prev_ts <= INTERVAL 7 DAY AND pe = exit_code AND ph <> raw_hash",
    "content_hash_duplicates": "SELECT left(sha256(text), 12) AS ref, count(*) AS n, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "multiset_line_diff": f"""WITH {_BASE}, p AS (SELECT id, prev_id FROM b WHERE ts - prev_ts <= INTERVAL 30 DAY AND pe = exit_code AND ph <> raw_hash),
e AS (SELECT id, 1 AS d, unnest(string_split(regexp_replace(coalesce(c.raw_combined, ''), '\\n$', ''), chr(10))) AS line FROM p JOIN captures c ON c.capture_id = p.id
 UNION ALL SELECT id, -1, unnest(string_split(regexp_replace(coalesce(c.raw_combined, ''), '\\n$', ''), chr(10))) FROM p JOIN captures c ON c.capture_id = p.prev_id),
g AS (SELECT id, line, sum(d) AS d FROM e GROUP BY ALL) SELECT id, sum(greatest(d, 0))::BIGINT AS added, sum(greatest(-d, 0))::BIGINT AS removed FROM g GROUP BY id""",
    "orphan_artifacts_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM subject_labels WHERE doc_id IS NOT NULL)",
    "hint_lookup": f"WITH {_HINTS} SELECT id, hint_id FROM l",
    "hint_rollback": f"WITH {_HINTS} SELECT hint_id, count(*) AS runs, count_if(exit_code <> 0) AS harmful FROM l GROUP BY hint_id HAVING count(*) >= 5 AND count_if(exit_code <> 0) * 100.0 >= 20.0 * count(*)",
}
