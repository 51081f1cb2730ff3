"""Queries that render captures, route commands and read the output of tools, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from linelore.functions import text as T
from linelore.functions.fingerprint import fingerprint
from linelore.operators import dedup as D
from linelore.operators import domain as M
from linelore.operators import history as H
from linelore.operators import lines as L
from linelore.operators import render as R
from linelore.operators import reduce as RD
from linelore.operators import route
from linelore.plans import fixtures
from linelore.plans.history import SQL as history_sql
from linelore.plans.joins import _BASE as _JOINS_BASE
from linelore.plans.joins import _runs
from linelore.plans.text import NO_ANSI, _LINES, trim_sql
from linelore.session import spread_table, table


def _c(spark, root):
    return spread_table(spark, root, "captures").select("capture_id", "exit_code", "profile_name", F.col("raw_combined").alias("text"))


def content_route(spark, root):
    c = _c(spark, root).select(R.content_route(T.strip_ansi(F.col("text"))).alias("route"))
    d = spread_table(spark, root, "documents").select(R.content_route(F.col("text")).alias("route"))
    return c.unionByName(d).groupBy("route").agg(F.count("*").alias("n"))


def binary_sniff(spark, root):
    return spread_table(spark, root, "documents").select("doc_id", R.is_binary(F.coalesce("text", F.lit(""))).alias("binary"))


def _rendered(spark, root, **options):
    c = spread_table(spark, root, "captures").select("capture_id", "exit_code", "profile_name", F.array_join("command", " ").alias("command"), F.col("raw_combined").alias("text"))
    return R.render(c, "text", "exit_code", "profile_name", R.EngineOptions(**options), F.col("command"))


def render_captures(spark, root):
    return _rendered(spark, root).select("capture_id", "route", "raw_tokens", "budget_lines", "bypassed", "filtered_tokens", "saved_tokens", "savings_pct", "repairs", "rendered")


def render_savings(spark, root):
    return _rendered(spark, root).groupBy("profile_name").agg(F.count("*").alias("n"), F.sum("raw_tokens").alias("raw"), F.sum("filtered_tokens").alias("filtered"))


def render_ultra_compact(spark, root):
    return _rendered(spark, root, ultra_compact=True).select("capture_id", "filtered_tokens", "rendered")


def render_recovery(spark, root):
    r = _rendered(spark, root).withColumn("path", F.concat(F.lit("out/"), F.col("capture_id").cast("string"), F.lit(".txt")))
    omitted = F.size(L.reducer_lines(F.coalesce("text", F.lit("")))) - F.size(L.reducer_lines(F.col("rendered")))
    return R.with_recovery(r, "rendered", omitted, "path").select("capture_id", "rendered")


def fast_path(spark, root):
    """Which outputs are shown as they are."""
    return _rendered(spark, root).select("capture_id", "bypassed")


def fixture_measurements(spark, root):
    """The acceptance corpus: savings and quality of each kind against its gates."""
    return R.measure(spark.createDataFrame(fixtures.fixtures(), fixtures.SCHEMA)).withColumn("lost", F.concat_ws(", ", "lost"))


def quality_score(spark, root):
    return R.quality(_rendered(spark, root), "text", "rendered", "exit_code").select("capture_id", "quality")


def retention_verify(spark, root):
    return _rendered(spark, root).select("capture_id", "missing", "repairs")


def never_worse_than_raw(spark, root):
    return _rendered(spark, root).groupBy((F.col("filtered_tokens") <= F.col("raw_tokens")).alias("ok")).agg(F.count("*").alias("n"))


def _session(spark, root):
    c = spread_table(spark, root, "captures")
    return c.select(F.col("capture_id").alias("id"), F.col("captured_at").alias("ts"), fingerprint(F.array_join("command", " ")).alias("fingerprint"), "cwd", "exit_code", F.col("profile_name").alias("profile"), F.col("raw_combined").alias("text"))


def session_renders(spark, root):
    return R.session_renders(_session(spark, root), R.EngineOptions(dedup_window_minutes=7 * 24 * 60))


def _budgeted(spark, root):
    h = table(spark, root, "history").where("command_fingerprint is not null").select("seq", F.col("command_fingerprint").alias("fingerprint"), "profile", "profile_confidence")
    return h.withColumn("budget_lines", R.budget_lines(F.col("profile"), F.lit(""), R.EngineOptions()))


def history_budget_adapter(spark, root):
    s = H.budget_suggestions(table(spark, root, "history"), lookback=None)
    return R.adapt_budgets(_budgeted(spark, root), s).select("seq", "adapted_lines", "adapted_bytes", "adapted_tokens", "adaptation")


def gateway_budget_adapter(spark, root):
    s = H.budget_suggestions(table(spark, root, "history"), lookback=None)
    return R.adapt_budgets(_budgeted(spark, root), s, 10, 15, False, None, 20).select("seq", "adapted_lines", "adapted_bytes", "adapted_tokens", "adaptation")


def hard_cap_tokens(spark, root):
    d = _c(spark, root).where("text is not null")
    return d.select("capture_id", T.estimate_tokens(R.hard_cap_tokens(F.col("text"), F.lit(64))).alias("tokens"))


def fit_priority_lines(spark, root):
    d = _c(spark, root).withColumn("ls", L.reducer_lines(F.col("text")))
    tier = lambda x: F.when(x.rlike("FAIL|ERROR"), 0).when(x.rlike("(?i)warn"), 1).otherwise(2)
    cands = F.transform("ls", lambda x, i: F.struct(tier(x).alias("tier"), i.alias("pos"), T.estimate_tokens(F.concat(x, F.lit("\n"))).cast("int").alias("cost")))
    return d.select("capture_id", R.fit_priority_lines(cands, 12, 120).alias("kept"))


def budget_lines(spark, root):
    p = table(spark, root, "history").select("profile", "profile_confidence").distinct()
    modes = [R.EngineOptions(reasoning_budget_mode=m) for m in ("standard", "agent", "aggressive")]
    return p.select("profile", "profile_confidence", *[R.budget_lines(F.col("profile"), F.col("profile_confidence"), o).alias(o.reasoning_budget_mode) for o in modes])


def _pairs(spark, root):
    p = D.delta_baselines(_runs(spark, root), 30 * 86_400)
    c = spread_table(spark, root, "captures").select("capture_id", "raw_combined")
    return p.join(c.select(F.col("capture_id").alias("id"), F.col("raw_combined").alias("new")), "id").join(c.select(F.col("capture_id").alias("prev_id"), F.col("raw_combined").alias("old")), "prev_id")


def delta_digests(spark, root):
    p = _pairs(spark, root).withColumns({"s": F.lit(60), "ref": D.reference(D.content_hash(F.coalesce("old", F.lit(""))))})
    return R.delta_digest(p, "new", "old", "new", "s", "ref").select("id", "prev_id", "digest")


def excess_lines(spark, root):
    """The lines that a run has more of than its baseline, one for one."""
    return D.excess_lines(_pairs(spark, root).select("id", "new", "old"), "new", "old")


def profile_route(spark, root):
    h = table(spark, root, "history").where("command is not null")
    return h.groupBy("profile", route.profile(H.words(F.col("command"))).alias("routed")).agg(F.count("*").alias("n"))


def failure_exits(spark, root):
    h = table(spark, root, "history")
    return h.groupBy("profile").agg(F.count_if(route.failed(F.col("exit_code"), F.col("profile"))).alias("failed"))


def _lines(spark, root):
    return M.tool_lines(_c(spark, root), "capture_id", "text")


def layer_states(spark, root):
    return M.last_states(_lines(spark, root), M.LAYER)


def rollout_states(spark, root):
    return M.last_states(_lines(spark, root), M.ROLLOUT)


def check_states(spark, root):
    return M.last_states(_lines(spark, root), M.CHECK)


def test_results(spark, root):
    return M.test_results(_lines(spark, root))


def listing_counts(spark, root):
    return M.listing(_lines(spark, root))


def status_counts(spark, root):
    return M.status_counts(_lines(spark, root))


def tool_reductions(spark, root):
    """What the reducer of its profile shows of each capture, before any contract."""
    c = spread_table(spark, root, "captures").select("capture_id", "raw_combined", "profile_name", "exit_code", F.array_join("command", " ").alias("command"))
    return RD.reduce_texts(c, "raw_combined", "profile_name", "exit_code", "command").select("capture_id", "profile_name", "reduced")


def rollouts(spark, root):
    return M.applied(_lines(spark, root))


def compose_states(spark, root):
    return M.last_states(_lines(spark, root), M.COMPOSE)


def pipeline_statuses(spark, root):
    return M.pipelines(_lines(spark, root))


def explain_route(spark, root):
    """What the router says about each distinct command: its words without wrappers, profile, and the limits of its fast path."""
    return route.explain(table(spark, root, "history").where("command is not null").select("command").distinct(), "command")


_LIST = (content_route, binary_sniff, render_captures, render_savings, render_ultra_compact, render_recovery, fast_path, fixture_measurements, quality_score, retention_verify, never_worse_than_raw, session_renders, history_budget_adapter, gateway_budget_adapter, hard_cap_tokens, fit_priority_lines, budget_lines, delta_digests, excess_lines, profile_route, explain_route, failure_exits, layer_states, rollout_states, check_states, compose_states, pipeline_statuses, rollouts, test_results, listing_counts, status_counts, tool_reductions)
QUERIES = {f.__name__: f for f in _LIST}

_TL = f"l AS (SELECT id AS record_id, line_no, regexp_replace(line, '[\\s\\x0B]+$', '') AS line FROM ({_LINES.format(src='SELECT capture_id AS id, replace(' + NO_ANSI + ', chr(13), chr(0)) AS t FROM captures').replace('chr(0)', repr(''))}) WHERE {trim_sql('line')} <> '')"


def _states(p: str) -> str:
    p = p.replace("'", "''")
    return f"""WITH {_TL}, m AS (SELECT record_id, line_no, regexp_extract(line, '{p}', 1) AS thing, regexp_extract(line, '{p}', 2) AS state FROM l WHERE regexp_matches(line, '{p}'))
SELECT record_id, thing, arg_max(state, line_no) AS state, count(*) - 1 AS updates, min(line_no)::INT AS first_line FROM m GROUP BY ALL"""


_LIST_P = "^(?:\\[[0-9:]+\\] )?([d-])[rwxsStT-]{9}\\S*\\s"
SQL = {
    "layer_states": _states(M.LAYER),
    "rollout_states": _states(M.ROLLOUT),
    "check_states": _states(M.CHECK),
    "listing_counts": f"""WITH {_TL}, m AS (SELECT record_id, regexp_extract(line, '{_LIST_P}', 1) AS k, regexp_extract(line, '(\\S+)$', 1) AS name FROM l WHERE regexp_matches(line, '{_LIST_P}'))
SELECT record_id, count_if(k = 'd') AS dirs, count_if(k = '-') AS files, count_if(starts_with(name, '.')) AS hidden FROM m GROUP BY record_id""",
    "test_results": f"""WITH {_TL}, m AS (SELECT record_id, line_no, regexp_extract(line, '{M.TEST}', 1) AS o, regexp_extract(line, '{M.TEST}', 2) AS t FROM l WHERE regexp_matches(line, '{M.TEST}')),
b AS (SELECT record_id, t, min(line_no) AS k FROM m WHERE o = 'FAIL' GROUP BY ALL), f AS (SELECT record_id, array_to_string(list(t ORDER BY k)[1:4], ', ') AS failing FROM b GROUP BY record_id)
SELECT record_id, count_if(o IN ('PASS', 'ok')) AS passed, count_if(o = 'FAIL') AS failed, coalesce(max(failing), '') AS failing FROM m LEFT JOIN f USING (record_id) GROUP BY record_id""",
    "failure_exits": "SELECT profile, count_if(exit_code <> 0 AND NOT (profile IN ('ripgrep', 'grep', 'patch-diff', 'git-diff') AND exit_code = 1)) AS failed FROM history GROUP BY profile",
}
# Rules written from the inventory, not from the code's constants.
_BASE = """CASE WHEN contains(coalesce(profile, ''), 'log') THEN greatest(12, 12) WHEN profile IN ('ripgrep', 'generic-summary', 'git-status') THEN (12 * 4 + 4) // 5
 WHEN profile = 'python-tooling' THEN (12 * 9 + 7) // 8 WHEN profile = 'pytest' THEN (12 * 5 + 3) // 4 ELSE 12 END"""


def _budget_sql(num: int, den: int, confidence: str) -> str:
    v = f"(({_BASE}) * {num} + {den - 1}) // {den}"
    return f"least(greatest(CASE {confidence} WHEN 'low' THEN ({v} * 5 + 3) // 4 WHEN 'medium' THEN ({v} * 9 + 7) // 8 ELSE {v} END, 3), 40)::INT"


SQL["budget_lines"] = "SELECT DISTINCT profile, profile_confidence, " + ", ".join(f"{_budget_sql(n, d, 'profile_confidence')} AS {m}" for m, n, d in (("standard", 1, 1), ("agent", 3, 4), ("aggressive", 1, 2))) + " FROM history"
SQL["binary_sniff"] = "SELECT doc_id, length(left(coalesce(text, ''), 4096)) > 0 AND length(regexp_replace(left(coalesce(text, ''), 4096), '[^\\x00-\\x08\\x0E-\\x1A\\x1C-\\x1F\\x7F\\x{FFFD}]', '', 'g')) * 10 > length(left(coalesce(text, ''), 4096)) AS \"binary\" FROM documents"
_ADAPT = """WITH g AS ({suggest}), b AS (SELECT h.seq, h.profile, g.profile AS sp, direction, reason, confidence, samples, max_lines, max_bytes, max_tokens, {base} AS n FROM history h LEFT JOIN g ON g.fingerprint = h.command_fingerprint WHERE h.command_fingerprint IS NOT NULL),
p AS (SELECT *, {heavy} AS up FROM b),
a AS (SELECT *, least(greatest(CASE direction WHEN 'tighten' THEN greatest(max_lines, (n * {low} + 99) // 100) ELSE least(max_lines, (n * up + 99) // 100) END, 3), 40) AS l,
 CASE direction WHEN 'tighten' THEN greatest(max_bytes, (n * 160 * {low} + 99) // 100) ELSE least(max_bytes, (n * 160 * up + 99) // 100) END AS y,
 CASE direction WHEN 'tighten' THEN greatest(max_tokens, (n * 32 * {low} + 99) // 100) ELSE least(max_tokens, (n * 32 * up + 99) // 100) END AS k FROM p),
o AS (SELECT *, coalesce(sp = profile AND {trust} AND (abs(l - n) >= 2 OR abs(y - n * 160) >= 64 OR abs(k - n * 32) >= 12)
 AND CASE direction WHEN 'tighten' THEN l <= n AND y <= n * 160 AND k <= n * 32 ELSE l >= n AND y >= n * 160 AND k >= n * 32 END, false) AS ok FROM a)
SELECT seq, (CASE WHEN ok THEN l ELSE n END)::BIGINT AS adapted_lines, (CASE WHEN ok THEN y ELSE n * 160 END)::BIGINT AS adapted_bytes, (CASE WHEN ok THEN k ELSE n * 32 END)::BIGINT AS adapted_tokens, CASE WHEN ok THEN direction END AS adaptation FROM o"""
_N = f"({_BASE.replace('profile', 'h.profile')})"
_SUGGESTED = history_sql["budget_suggestions"]
SQL["history_budget_adapter"] = _ADAPT.format(suggest=_SUGGESTED, base=_N, low=80, heavy="CASE WHEN reason = 'fallback_heavy' THEN CASE confidence WHEN 'high' THEN 175 WHEN 'medium' THEN 150 ELSE 135 END ELSE 125 END", trust="confidence IN ('high', 'medium')")
SQL["gateway_budget_adapter"] = _ADAPT.format(suggest=_SUGGESTED, base=_N, low=90, heavy="115", trust="samples >= 20")
SQL["status_counts"] = f"""WITH {_TL}, e AS (SELECT record_id, line, regexp_matches(line, '^[MADRCUT?! ][MADRCUT?! ] +\\S') AND NOT starts_with(line, '## ') AND NOT starts_with(line, '  ') AS entry FROM l)
SELECT record_id, count_if(entry AND line[1] IN ('M', 'A', 'D', 'R', 'C', 'U', 'T')) AS staged, count_if(entry AND line[2] IN ('M', 'A', 'D', 'R', 'C', 'U', 'T')) AS unstaged, count_if(entry AND line[1] = '?') AS untracked,
 coalesce(max(CASE WHEN starts_with(line, '## ') THEN substr(line, 4, 200) END), '') AS branch FROM e WHERE entry OR starts_with(line, '## ') GROUP BY record_id"""
SQL["compose_states"] = _states("^\\s*(?:Container|Network|Volume)\\s+(\\S+)\\s+(Creating|Created|Starting|Started|Healthy|Waiting|Stopping|Stopped|Removed|Error)")
SQL["excess_lines"] = f"""WITH {_JOINS_BASE}, p AS (SELECT id, prev_id FROM b WHERE ts - prev_ts <= INTERVAL 30 DAY AND pe = exit_code AND ph <> raw_hash),
x AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT p.id, string_split(c.raw_combined, chr(10)) AS ls FROM p JOIN captures c ON c.capture_id = p.id JOIN captures o ON o.capture_id = p.prev_id)),
y AS (SELECT id, line, count(*) AS n FROM (SELECT p.id, unnest(string_split(c.raw_combined, chr(10))) AS line FROM p JOIN captures c ON c.capture_id = p.prev_id) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY id, line ORDER BY line_no) AS k FROM x)
SELECT k.id, k.line_no::INT AS line_no, k.line FROM k LEFT JOIN y USING (id, line) WHERE k.k > coalesce(y.n, 0)"""
SQL["never_worse_than_raw"] = "SELECT true AS ok, count(*) AS n FROM captures"
