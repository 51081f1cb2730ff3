"""Queries over the history of runs and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelore.operators import history as H
from linelore.session import table


def _h(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "history")


def history_summary(spark, root):
    return H.summary(_h(spark, root))


def history_by_command(spark, root):
    return H.by_command(_h(spark, root))


def top_commands(spark, root):
    return H.by_command(_h(spark, root), 20)


def history_by_profile(spark, root):
    return H.by_profile(_h(spark, root))


def profile_histogram(spark, root):
    return H.profile_histogram(_h(spark, root))


def command_hotspots(spark, root):
    return H.command_hotspots(_h(spark, root))


def fingerprint_hotspots(spark, root):
    return H.fingerprint_hotspots(_h(spark, root))


def budget_suggestions(spark, root):
    return H.budget_suggestions(_h(spark, root), lookback=None)


def budget_suggestions_recent(spark, root):
    return H.budget_suggestions(_h(spark, root), lookback=200)


def totals_fold_combine(spark, root):
    """The history archived in two parts and combined: the same as in one."""
    h = _h(spark, root)
    early = F.coalesce(F.col("timestamp") < F.lit("2025-09-10").cast("timestamp_ntz"), F.lit(False))
    return H.combine_totals(H.fold_totals(h.where(early)), H.fold_totals(h.where(~early)))


def history_compaction_retain(spark, root):
    return H.retained(_h(spark, root), F.col("command"), 40_000)


def savings_cost(spark, root):
    return H.cost_report(_h(spark, root))


def recent_runs(spark, root):
    return H.recent(_h(spark, root)).select("seq", "timestamp", "command", "command_fingerprint", "profile_confidence", "raw_bytes_read", "bytes_parsed", "bytes_emitted")


def profile_savings_ratio(spark, root):
    return H.savings_ratio(_h(spark, root))


_LIST = (history_summary, history_by_command, top_commands, history_by_profile, profile_histogram, command_hotspots, fingerprint_hotspots, budget_suggestions, budget_suggestions_recent, totals_fold_combine, history_compaction_retain, savings_cost, recent_runs, profile_savings_ratio)
QUERIES = {f.__name__: f for f in _LIST}

# FNV-1a of the lower-cased command with single spaces, in 128-bit arithmetic.
FP = """lower(lpad(to_hex((list_reduce(list_prepend(14695981039346656037::HUGEINT,
  list_transform(string_split(lower(trim(regexp_replace(command, '\\s+', ' ', 'g'))), ''), lambda c: ord(c)::HUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616))::UBIGINT), 16, '0'))"""
_CONF = " ".join(f"WHEN profile IN ({', '.join(repr(p) for p in ps)}) THEN '{c}'" for c, ps in H.CONFIDENCE.items())
HYDRATED = f"""
h0 AS (SELECT seq, "timestamp", command, coalesce(nullif(command_fingerprint, ''), {FP}) AS command_fingerprint, profile,
  CASE WHEN coalesce(profile_confidence, '') <> '' THEN profile_confidence ELSE CASE {_CONF} ELSE '' END END AS profile_confidence,
  coalesce(duration_ms, 0) AS duration_ms, coalesce(exit_code, 0) AS exit_code,
  coalesce(nullif(raw_bytes_read, 0), nullif(raw_bytes, 0), CASE WHEN raw_tokens > 0 THEN raw_tokens * 4 END, 0) AS raw_bytes_read,
  coalesce(bytes_parsed, 0) AS bp, coalesce(nullif(bytes_emitted, 0), nullif(filtered_bytes, 0), CASE WHEN filtered_tokens > 0 THEN filtered_tokens * 4 END, 0) AS bytes_emitted,
  coalesce(raw_tokens, 0) AS raw_tokens, coalesce(filtered_tokens, 0) AS filtered_tokens, coalesce(saved_tokens, 0) AS saved_tokens,
  coalesce(savings_pct, 0)::DECIMAL(18,4) AS pct, coalesce(fallback_used, false) OR coalesce(profile, '') = 'passthrough' AS fallback_used,
  coalesce(empty_result, false) AS empty_result, coalesce(passthrough, false) AS passthrough, coalesce(tee_path, '') AS tee_path FROM history),
h AS (SELECT *, coalesce(nullif(bp, 0), raw_bytes_read) AS bytes_parsed FROM h0)
"""
_KEY = "array_to_string(string_split(trim(regexp_replace(command, '\\s+', ' ', 'g')), ' ')[1:3], ' ')"
_COUNTERS = """count(*) AS commands, sum(raw_tokens) AS raw_tokens, sum(filtered_tokens) AS filtered_tokens, sum(saved_tokens) AS saved_tokens,
 count_if(passthrough) AS passthrough_commands, sum(CASE WHEN passthrough THEN raw_tokens ELSE 0 END) AS passthrough_tokens, sum(duration_ms) AS total_duration_ms,
 count_if(exit_code <> 0) AS failures, count_if(fallback_used) AS fallbacks, count_if(empty_result) AS empty_results, count_if(tee_path <> '') AS tee_count,
 sum(raw_bytes_read) AS raw_bytes_read, sum(bytes_parsed) AS bytes_parsed, sum(bytes_emitted) AS bytes_emitted,
 coalesce(sum(pct) FILTER (WHERE NOT passthrough), 0)::DOUBLE AS savings_pct_sum"""
_RATES = """savings_pct_sum / (commands - passthrough_commands) AS average_pct, saved_tokens::DOUBLE * 100 / (raw_tokens - passthrough_tokens) AS filtered_savings_pct,
 failures::DOUBLE * 100 / commands AS failure_rate, fallbacks::DOUBLE * 100 / commands AS fallback_rate, empty_results::DOUBLE * 100 / commands AS empty_result_rate, tee_count::DOUBLE * 100 / commands AS tee_rate"""


def _ints(cols: str) -> str:
    return ", ".join(f"{c}::BIGINT AS {c}" for c in cols.split())


_INT_COUNTERS = _ints("commands raw_tokens filtered_tokens saved_tokens passthrough_commands passthrough_tokens total_duration_ms failures fallbacks empty_results tee_count raw_bytes_read bytes_parsed bytes_emitted")
_RANKS = "quantile_disc(duration_ms, 0.5)::BIGINT AS duration_p50_ms, quantile_disc(duration_ms, 0.95)::BIGINT AS duration_p95_ms"
_PCT = "sum(pct)::DOUBLE / count(*) AS average_pct"

_BY_COMMAND = f"WITH {HYDRATED} SELECT {_KEY} AS command, count(*) AS count, {_PCT}, sum(saved_tokens)::BIGINT AS saved_tokens, sum(raw_tokens)::BIGINT AS raw_tokens, sum(filtered_tokens)::BIGINT AS filtered_tokens FROM h WHERE NOT passthrough GROUP BY 1"

_SUGGEST = """
p AS (SELECT command_fingerprint, profile FROM (SELECT command_fingerprint, profile, count(*) AS n FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY command_fingerprint ORDER BY n DESC, profile) = 1),
g AS (SELECT command_fingerprint, count(*) AS samples, arg_max(command, ("timestamp", -seq)) AS command, sum(pct)::DOUBLE / count(*) AS average_savings_pct,
  count_if(fallback_used AND NOT empty_result)::DOUBLE * 100 / count(*) AS fallback_rate, count_if(exit_code <> 0)::DOUBLE * 100 / count(*) AS failure_rate,
  """ + ", ".join(f"quantile_disc({b}, {p})::BIGINT AS {a}_{b}" for a, p in (("median", 0.5), ("p95", 0.95)) for b in ("raw_tokens", "filtered_tokens", "bytes_emitted")) + """,
  min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM r GROUP BY command_fingerprint HAVING count(*) >= 3),
s AS (SELECT *, CASE WHEN fallback_rate >= 50 AND failure_rate <= 80 THEN 'fallback_heavy'
  WHEN average_savings_pct >= 92 AND median_raw_tokens >= 80 AND median_filtered_tokens <= 20 AND failure_rate <= 80 THEN 'aggressive_compression'
  WHEN average_savings_pct <= 35 AND median_filtered_tokens >= 48 AND fallback_rate <= 25 THEN 'noisy' END AS reason,
  CASE WHEN fallback_rate >= 75 THEN 150 ELSE 125 END AS sc FROM g),
t AS (SELECT *, CASE reason WHEN 'fallback_heavy' THEN greatest((p95_filtered_tokens * sc + 99) // 100, median_filtered_tokens + 8, 24)
  WHEN 'aggressive_compression' THEN greatest((p95_filtered_tokens * 3 + 1) // 2, median_raw_tokens // 6, 24) ELSE greatest((p95_filtered_tokens * 3 + 3) // 4, 24) END AS max_tokens FROM s WHERE reason IS NOT NULL),
b AS (SELECT *, CASE reason WHEN 'fallback_heavy' THEN greatest((p95_bytes_emitted * sc + 99) // 100, median_bytes_emitted + 32, 96)
  WHEN 'aggressive_compression' THEN greatest((p95_bytes_emitted * 3 + 1) // 2, max_tokens * 4, 96) ELSE greatest((p95_bytes_emitted * 3 + 3) // 4, 96) END AS max_bytes FROM t)
SELECT b.command_fingerprint AS fingerprint, b.* EXCLUDE (command_fingerprint, sc), p.profile, least(greatest((max_bytes + 47) // 48, (max_tokens + 11) // 12, 3), 40) AS max_lines,
  CASE WHEN reason = 'noisy' THEN 'tighten' ELSE 'loosen' END AS direction, (CASE WHEN reason = 'noisy' THEN 0.75 WHEN reason = 'fallback_heavy' AND sc = 125 THEN 1.25 ELSE 1.5 END)::DOUBLE AS scale,
  CASE WHEN samples >= 6 THEN 'high' WHEN samples >= 4 THEN 'medium' ELSE 'low' END AS confidence,
  round(CASE reason WHEN 'fallback_heavy' THEN fallback_rate + failure_rate / 4 WHEN 'aggressive_compression' THEN average_savings_pct - 80 + median_raw_tokens / 16
    ELSE 35 - average_savings_pct + median_filtered_tokens / 4 END, 4) AS severity
FROM b JOIN p USING (command_fingerprint)"""

SQL = {
    "history_summary": f"WITH {HYDRATED}, t AS (SELECT {_COUNTERS}, {_RANKS} FROM h) SELECT {_INT_COUNTERS}, duration_p50_ms, duration_p95_ms, {_RATES} FROM t",
    "history_by_command": _BY_COMMAND,
    "top_commands": _BY_COMMAND + " ORDER BY count DESC, command LIMIT 20",
    "history_by_profile": f"""WITH {HYDRATED}, c AS (SELECT profile, profile_confidence AS confidence FROM (SELECT profile, profile_confidence, count(*) AS n FROM h WHERE NOT passthrough AND profile_confidence <> '' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY profile ORDER BY n DESC, profile_confidence) = 1),
g AS (SELECT profile, count(*) AS commands, {_PCT}, sum(saved_tokens)::BIGINT AS saved_tokens, sum(raw_tokens)::BIGINT AS raw_tokens, sum(filtered_tokens)::BIGINT AS filtered_tokens,
  count_if(exit_code <> 0)::DOUBLE * 100 / count(*) AS failure_rate, count_if(fallback_used)::DOUBLE * 100 / count(*) AS fallback_rate, count_if(empty_result)::DOUBLE * 100 / count(*) AS empty_result_rate,
  count_if(tee_path <> '')::DOUBLE * 100 / count(*) AS tee_rate, {_RANKS} FROM h WHERE NOT passthrough GROUP BY profile)
SELECT g.*, coalesce(c.confidence, '') AS confidence FROM g LEFT JOIN c USING (profile)""",
    "profile_histogram": "SELECT profile, count(*) AS n FROM history GROUP BY profile",
    "command_hotspots": f"""WITH {HYDRATED}, g AS (SELECT {_KEY} AS command, profile, count(*) AS commands, {_PCT}, count_if(exit_code <> 0)::DOUBLE * 100 / count(*) AS failure_rate,
  count_if(fallback_used)::DOUBLE * 100 / count(*) AS fallback_rate, {_RANKS}, sum(raw_tokens)::DOUBLE AS raw, sum(filtered_tokens)::DOUBLE AS fil FROM h WHERE NOT passthrough AND raw_tokens > 0 GROUP BY 1, 2),
s AS (SELECT *, raw / (raw + 64) AS vol, (raw >= 96 OR fil >= 72) AS worth, greatest(raw, fil) AS most FROM g)
SELECT command, profile, commands, average_pct, failure_rate, fallback_rate, duration_p50_ms, duration_p95_ms, round((fil * vol * 0.85::DOUBLE
  + (raw * (fallback_rate / 100) * 0.25::DOUBLE + CASE WHEN fallback_rate >= 50 AND worth THEN most * (fallback_rate / 100) * 0.20::DOUBLE ELSE 0 END) + raw * (failure_rate / 100) * 0.20::DOUBLE
  + greatest(0, duration_p95_ms::DOUBLE - 75) * vol / 6
  + CASE WHEN worth THEN greatest(0, CASE WHEN raw >= 1024 OR fil >= 768 THEN 18 WHEN raw >= 256 OR fil >= 192 THEN 12 ELSE 8 END - average_pct) * most / 110
    WHEN raw < 32 AND fil < 32 AND average_pct >= -20 THEN 0 ELSE greatest(0, -average_pct) * raw / 200 END)
  * (1 + (commands * 16)::DOUBLE / (commands * 16 + 24)), 4) AS severity
FROM s WHERE NOT (commands < 2 AND raw < 48 AND average_pct >= 0 AND fallback_rate = 0 AND failure_rate = 0) AND NOT (average_pct >= 40 AND fallback_rate < 50)""",
    "fingerprint_hotspots": f"""WITH {HYDRATED}, g AS (SELECT command_fingerprint AS fingerprint, arg_min(command, seq) AS command, arg_min(profile, seq) AS profile, count(*) AS commands, {_PCT}, {_RANKS},
  sum(raw_tokens) AS raw, sum(filtered_tokens)::BIGINT AS residual FROM h WHERE NOT passthrough AND raw_tokens > 0 GROUP BY 1)
SELECT * EXCLUDE (raw) FROM g WHERE average_pct < 40 AND NOT (commands < 2 AND (average_pct >= 0 OR raw < 16 OR (raw < 24 AND average_pct > -25)))""",
    "budget_suggestions": f"WITH {HYDRATED}, r AS (SELECT * FROM h WHERE command_fingerprint <> '' AND NOT passthrough), {_SUGGEST}",
    "budget_suggestions_recent": f"""WITH {HYDRATED}, l AS (SELECT * FROM h ORDER BY "timestamp" DESC NULLS LAST, seq DESC LIMIT 200), r AS (SELECT * FROM l WHERE command_fingerprint <> '' AND NOT passthrough), {_SUGGEST}""",
    "totals_fold_combine": f"WITH {HYDRATED}, t AS (SELECT {_COUNTERS} FROM h WHERE NOT coalesce(regexp_matches(lower(trim(regexp_replace(command, '\\s+', ' ', 'g'))), '^uninstall( |$)'), false)) SELECT {_INT_COUNTERS}, savings_pct_sum, {_RATES} FROM t",
    "history_compaction_retain": """WITH s AS (SELECT seq, strlen(command) + 1 AS b, row_number() OVER (ORDER BY seq DESC) AS rn, sum(strlen(command) + 1) OVER (ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS run FROM history)
SELECT seq, rn <= 2500 AND (rn = 1 OR run <= 40000) AS kept FROM s""",
    "savings_cost": "SELECT sum(saved_tokens)::BIGINT AS saved_tokens, sum(saved_tokens)::DOUBLE * 3.0::DOUBLE / 1000000 AS saved_cost, sum(saved_tokens)::DOUBLE / 200000 AS context_windows FROM history",
    "recent_runs": f"""WITH {HYDRATED} SELECT seq, "timestamp", command, command_fingerprint, profile_confidence, raw_bytes_read, bytes_parsed, bytes_emitted FROM h ORDER BY "timestamp" DESC NULLS LAST, seq DESC LIMIT 20""",
    "profile_savings_ratio": f"""WITH {HYDRATED}, g AS (SELECT profile, count(*) AS samples, sum(saved_tokens)::DOUBLE AS saved, sum(raw_tokens)::DOUBLE AS raw FROM h WHERE NOT passthrough AND raw_tokens > 0 GROUP BY profile)
SELECT profile, samples, (CASE WHEN samples < 3 THEN 0.60 ELSE least(greatest(saved / raw, 0), 0.95) END)::DOUBLE AS ratio FROM g""",
}
