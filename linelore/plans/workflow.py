"""Queries over the way commands are run, and over the messages of logs; their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from linelore.functions import text as T
from linelore.operators import history as H
from linelore.operators import logs
from linelore.operators import workflow as W
from linelore.plans.history import FP, HYDRATED, SQL as history_sql
from linelore.plans.text import NO_ANSI
from linelore.session import spread_table, table


def _h(spark, root):
    return table(spark, root, "history")


def workflow_hotspots(spark, root):
    return W.workflow_hotspots(_h(spark, root))


def recommendations(spark, root):
    return W.recommendations(H.budget_suggestions(_h(spark, root), lookback=None), W.workflow_hotspots(_h(spark, root)))


def command_families(spark, root):
    return _h(spark, root).where("command is not null").groupBy(W.family(F.col("command")).alias("family")).agg(F.count("*").alias("n"))


def missed_savings(spark, root):
    c = spread_table(spark, root, "captures").where("raw_combined is not null")
    o = c.select(F.array_join("command", " ").alias("command"), F.col("profile_name").alias("profile"), T.estimate_tokens(F.col("raw_combined")).alias("raw_tokens"), F.octet_length("raw_combined").alias("raw_bytes"))
    return W.missed_savings(o, H.savings_ratio(_h(spark, root)))


def missed_savings_total(spark, root):
    return W.with_total(missed_savings(spark, root), "command", 5)


def _lines(spark, root):
    return logs.log_lines(spread_table(spark, root, "captures"), "capture_id", "raw_combined")


def stream_messages(spark, root):
    return logs.stream_messages(_lines(spark, root))


def template_groups(spark, root):
    return logs.template_groups(_lines(spark, root)).select("template", "n")


def event_stats(spark, root):
    return logs.event_stats(table(spark, root, "events"), "user_id", "ts", "event_type").select("kind", "n", "sources")


def entry_templates(spark, root):
    from linelore.operators import logparse

    return logs.source_messages(logparse.parse_entries(spread_table(spark, root, "captures"), "capture_id", "raw_combined", "captured_at"))


_LIST = (workflow_hotspots, recommendations, command_families, missed_savings, missed_savings_total, stream_messages, template_groups, event_stats, entry_templates)
QUERIES = {f.__name__: f for f in _LIST}

_HEAD = "lower(string_split(trim(regexp_replace(command, '\\s+', ' ', 'g')), ' ')[1])"
_FAMILY = "CASE " + " ".join(f"WHEN {_HEAD} IN ({', '.join(repr(x) for x in heads.split())}) THEN '{name}'" for name, heads in (
    ("git", "git"), ("go", "go golangci-lint staticcheck"), ("javascript", "npm pnpm yarn bun npx node jest vitest tsc eslint"), ("python", "python python3 pytest ruff mypy black pip uv"), ("rust", "cargo rustc"), ("dotnet", "dotnet"),
    ("container", "docker podman"), ("kubernetes", "kubectl helm"), ("build", "make cmake ninja bazel mvn gradle gradlew terraform tofu pulumi"), ("search", "rg grep find fd"), ("files", "ls tree cat head tail less bat"), ("hosting", "gh glab"),
    ("cloud", "aws gcloud az vercel heroku fly"), ("data", "jq psql sqlite3 mysql duckdb"), ("http", "curl wget http"))) + " ELSE 'other' END"
_HOT = f"""{HYDRATED}, w AS (SELECT * FROM h WHERE command_fingerprint <> ''),
q AS (SELECT command_fingerprint AS fingerprint, duration_ms, row_number() OVER (PARTITION BY command_fingerprint ORDER BY duration_ms) - 1 AS k, count(*) OVER (PARTITION BY command_fingerprint) AS n FROM w),
pc AS (SELECT fingerprint, max(duration_ms) FILTER (WHERE k = floor((n - 1) * 0.5::DOUBLE)) AS p50_ms, max(duration_ms) FILTER (WHERE k = floor((n - 1) * 0.95::DOUBLE)) AS p95_ms FROM q GROUP BY fingerprint),
a AS (SELECT command_fingerprint AS fingerprint, arg_min(command, seq) AS command, arg_min(profile, seq) AS profile, count(*) AS runs, sum(pct)::DOUBLE / count(*) AS average_pct, count_if(exit_code <> 0)::DOUBLE * 100 / count(*) AS failure_rate,
 count_if(fallback_used) AS fb, count_if(fallback_used)::DOUBLE * 100 / count(*) AS fallback_rate, count_if(tee_path <> '') AS tees, count_if(tee_path <> '')::DOUBLE * 100 / count(*) AS tee_rate, sum(raw_tokens)::BIGINT AS raw, sum(filtered_tokens)::BIGINT AS residual FROM w GROUP BY 1),
i AS (SELECT a.*, p50_ms, p95_ms, profile = 'passthrough' OR starts_with(profile, 'generic-') AS gen, runs >= 2 AND average_pct < CASE WHEN raw // runs >= 512 OR residual // runs >= 384 THEN 30 WHEN raw // runs >= 192 OR residual // runs >= 144 THEN 24 WHEN raw // runs >= 72 OR residual // runs >= 48 THEN 20 END AS low FROM a JOIN pc USING (fingerprint)),
z AS (SELECT *, array_to_string(list_filter([CASE WHEN gen AND runs >= 3 THEN 'repeated-passthrough' END, CASE WHEN low THEN 'low-savings' END, CASE WHEN fb >= 2 AND fallback_rate >= 50 THEN 'fallback-heavy' END, CASE WHEN tees >= 2 AND tee_rate >= 50 THEN 'tee-heavy' END], lambda x: x IS NOT NULL), ',') AS signals FROM i),
y AS (SELECT *, (CASE WHEN signals LIKE '%repeated%' THEN 2 ELSE 0 END + CASE WHEN signals LIKE '%low-%' THEN 3 ELSE 0 END + CASE WHEN signals LIKE '%fallback%' THEN 3 ELSE 0 END + CASE WHEN signals LIKE '%tee-%' THEN 2 ELSE 0 END + CASE WHEN gen AND runs >= 2 THEN 1 ELSE 0 END + least(greatest(runs - 2, 0), 4))::INT AS coverage FROM z),
hot AS (SELECT fingerprint, command, profile, runs, average_pct, failure_rate, fallback_rate, tee_rate, residual, p50_ms, p95_ms, signals, coverage, {_FAMILY} AS family,
 round((100 - average_pct) + fallback_rate + failure_rate / 2 + tee_rate / 4 + p95_ms::DOUBLE / 25 + coverage * 12, 4) AS severity FROM y)"""
_MISSED = f"""r AS ({history_sql['profile_savings_ratio']}),
o AS (SELECT array_to_string(command, ' ') AS command, profile_name AS profile, raw_combined AS t FROM captures WHERE raw_combined IS NOT NULL AND strlen(raw_combined) >= 200),
k AS (SELECT command, profile, greatest((strlen(t) + 3) // 4, 1, len(regexp_extract_all(t, '[A-Za-z0-9]+')) + coalesce(list_sum(list_transform(list_filter(regexp_extract_all(t, '[A-Za-z0-9]+'), lambda x: strlen(x) > 12), lambda x: (strlen(x) - 9) // 8)), 0)
 + (len(regexp_extract_all(t, '[^A-Za-z0-9 \\n\\r\\t\\f\\x0B]+')) + 1) // 2)::BIGINT AS tok FROM o),
m AS (SELECT array_to_string(string_split(trim(regexp_replace(command, '\\s+', ' ', 'g')), ' ')[1:3], ' ') AS command, count(*) AS n, sum(tok)::BIGINT AS raw_tokens, sum(floor(tok * coalesce(ratio, 0.6)::DOUBLE + 0.5::DOUBLE))::BIGINT AS missed FROM k LEFT JOIN r ON r.profile = k.profile GROUP BY 1)"""
_RAW = f"""l AS (SELECT record_id, line_no, trim(x, ' ' || chr(9) || chr(11) || chr(12)) AS line FROM (SELECT capture_id AS record_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS line_no FROM (SELECT capture_id, string_split(replace({NO_ANSI}, chr(13), ''), chr(10)) AS ls FROM captures)))"""
_MASK = "array_to_string(list_transform(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' '), lambda t: CASE WHEN regexp_full_match(t, '[0-9a-fA-F-]{{8,}}') AND regexp_matches(t, '[0-9]') THEN '#' ELSE regexp_replace(t, '[0-9]+', 'N', 'g') END), ' ')"
_LABEL = "^([A-Za-z][\\w.-]*-[0-9]+) +\\| ?"
SQL = {
    "workflow_hotspots": f"WITH {_HOT} SELECT * FROM hot",
    "recommendations": f"""WITH sg AS ({history_sql['budget_suggestions']}), {_HOT}, top AS (SELECT family, arg_min(command, (-residual, fingerprint)) AS by_family FROM hot GROUP BY family),
s AS (SELECT fingerprint, direction, reason, {_FAMILY} AS family FROM sg)
SELECT s.fingerprint, direction, reason, coalesce(hot.command, by_family) AS command, CASE WHEN hot.command IS NOT NULL THEN 'fingerprint' WHEN by_family IS NOT NULL THEN 'family' END AS matched_by FROM s LEFT JOIN hot ON hot.fingerprint = s.fingerprint LEFT JOIN top ON top.family = s.family""",
    "command_families": f"SELECT {_FAMILY} AS family, count(*) AS n FROM history WHERE command IS NOT NULL GROUP BY 1",
    "missed_savings": f"WITH {_MISSED} SELECT * FROM m",
    "missed_savings_total": f"WITH {_MISSED} (SELECT * FROM m ORDER BY missed DESC, command LIMIT 5) UNION ALL SELECT 'total', sum(n)::BIGINT, sum(raw_tokens)::BIGINT, sum(missed)::BIGINT FROM m",
    "event_stats": "SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS sources FROM events GROUP BY 1",
    "template_groups": f"WITH {_RAW} SELECT {_MASK.format(c='line')} AS template, count(*) AS n FROM l WHERE line <> '' GROUP BY 1",
    "stream_messages": f"WITH {_RAW}, s AS (SELECT record_id, line_no, CASE WHEN regexp_matches(line, '{_LABEL}') THEN regexp_extract(line, '{_LABEL}', 1) ELSE 'log' END AS source, regexp_replace(line, '{_LABEL}', '') AS m FROM l WHERE line <> '') SELECT record_id, source, {_MASK.format(c='m')} AS message, count(*) AS n, min(line_no)::INT AS first_line FROM s GROUP BY ALL",
}
