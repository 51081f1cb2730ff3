"""Queries that reduce texts line by line, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from linelore.functions import text as T
from linelore.operators import lines as L
from linelore.operators import logs
from linelore.session import spread_table, table


def _captures(spark, root):
    return spread_table(spark, root, "captures").select("capture_id", "exit_code", F.col("raw_combined").alias("text"))


def token_estimate(spark, root):
    d = spread_table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def strip_ansi(spark, root):
    return _captures(spark, root).where("text is not null").select("capture_id", F.sha2(T.strip_ansi(F.col("text")), 256).alias("hash"))


def _spec(name):
    def q(spark, root):
        d = _captures(spark, root).withColumn("text", T.strip_ansi(F.col("text")))
        return L.apply_spec(d, L.BUILTIN[name]).select("capture_id", "rendered", "total_lines", "omitted")

    q.__name__ = name
    return q


def fold_consecutive(spark, root):
    d = L.apply_spec(_captures(spark, root), L.Spec("fold", dedup_consecutive=True))
    return d.select("capture_id", F.sha2("rendered", 256).alias("hash"), "total_lines")


def fold_similar(spark, root):
    d = L.apply_spec(_captures(spark, root), L.Spec("fold", fold_similar=True))
    return d.select("capture_id", "total_lines", F.sha2("rendered", 256).alias("hash"))


def head_tail_marker(spark, root):
    return L.apply_spec(_captures(spark, root), L.Spec("ends", drop_empty=True, head=5, tail=3)).select("capture_id", "rendered", "omitted")


def keep_strip_filter(spark, root):
    d = L.apply_spec(_captures(spark, root), L.Spec("some", keep_patterns=("(?i)fail", "(?i)error"), strip_patterns=(r"^\s*at ",)))
    return d.select("capture_id", "total_lines")


def similar_line_key(spark, root):
    l = L.explode_lines(_captures(spark, root), "capture_id", "text")
    return l.groupBy(T.similar_line_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"))


def log_template_key(spark, root):
    l = L.explode_lines(_captures(spark, root), "capture_id", "text")
    return l.groupBy(T.template_key(F.col("line")).alias("template")).agg(F.count("*").alias("n"))


def unique_lines_ordered(spark, root):
    d = _captures(spark, root).withColumn("ls", L.unique_lines(F.split("text", "\n")))
    return d.select("capture_id", F.size("ls").alias("n"), F.sha2(F.array_join("ls", "\n"), 256).alias("hash"))


def join_limited_lines(spark, root):
    d = _captures(spark, root).where("text is not null").withColumn("ls", L.unique_lines(F.split("text", "\n")))
    return d.select("capture_id", L.join_limited(F.col("ls"), 4).alias("rendered"))


def _log(spark, root):
    return logs.log_lines(_captures(spark, root), "capture_id", "text")


def severity_histogram(spark, root):
    return logs.severity_histogram(_log(spark, root))


def log_message_dedup(spark, root):
    return logs.message_groups(_log(spark, root)).select("record_id", "severity", "n", "first_line", "first_clock", "last_clock", "display")


def log_kind_priority_select(spark, root):
    return logs.prioritised(_log(spark, root))


def looks_like_log(spark, root):
    return logs.looks_like_log(_captures(spark, root), "capture_id", "text")


def failure_line_class(spark, root):
    l = L.explode_lines(_captures(spark, root), "capture_id", "text").select(T.trim(T.strip_ansi(F.col("line"))).alias("line")).where("line <> ''")
    return l.groupBy(T.failure_noise(F.col("line")).alias("noise"), T.failure_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


def failure_summary(spark, root):
    return logs.failure_summary(logs.failure_items(_captures(spark, root).where("exit_code <> 0"), "capture_id", "text"))


_LIST = [token_estimate, strip_ansi, *map(_spec, L.BUILTIN), fold_consecutive, fold_similar, head_tail_marker, keep_strip_filter, similar_line_key, log_template_key, unique_lines_ordered, join_limited_lines, severity_histogram, log_message_dedup, log_kind_priority_select, looks_like_log, failure_line_class, failure_summary]
QUERIES = {f.__name__: f for f in _LIST}

TOKENS = """CASE WHEN strlen({t}) = 0 THEN 0 ELSE greatest((strlen({t}) + 3) // 4, greatest(1, len(regexp_extract_all({t}, '[A-Za-z0-9]+'))
 + coalesce(list_sum(list_transform(regexp_extract_all({t}, '[A-Za-z0-9]+'), lambda x: CASE WHEN length(x) > 12 THEN (length(x) - 9) // 8 ELSE 0 END)), 0)
 + (len(regexp_extract_all({t}, '[^A-Za-z0-9 \\n\\r\\t\\f\\x0B]+')) + 1) // 2)) END"""
_S = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def collapse_sql(c: str) -> str:
    return f"regexp_replace({trim_sql(c)}, '[{_S}]+', ' ', 'g')"


NO_ANSI_PATTERN = r"\x1b\[[^@-~]*[@-~]"
NO_ANSI = f"regexp_replace(raw_combined, '{NO_ANSI_PATTERN}', '', 'g')"
# every line of a text with its number: {src} has id and t
_LINES = "SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT id, string_split(t, chr(10)) AS ls FROM ({src}))"
_SPEC_SRC = "SELECT id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT capture_id AS id, string_split(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM captures WHERE raw_combined IS NOT NULL)"
_CLOCK = "'^[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.,][0-9]+)?$'".replace("{{", "{").replace("}}", "}")


def _moment_sql(x: str) -> str:
    b = f"regexp_replace({x}, '^[\\[\\]]+|[\\[\\]]+$', '', 'g')"
    return f"(length({b}) >= 20 AND substr({b}, 5, 1) = '-' AND substr({b}, 8, 1) = '-' AND regexp_matches({b}, '[T_]') OR regexp_matches({b}, {_CLOCK}) OR regexp_matches({b}, '^([0-9]{{10}}|[0-9]{{13}})$'))"


def _cut_sql(w: str) -> str:
    n = f"CASE WHEN len({w}) >= 3 AND regexp_matches({w}[1], '^({T.MONTHS})$') AND regexp_matches({w}[2], '^[0-9]{{1,2}}$') AND regexp_matches({w}[3], {_CLOCK}) THEN 3 WHEN {_moment_sql(w + '[1]')} THEN 1 ELSE 0 END"
    return f"CASE WHEN ({n}) < len({w}) THEN {w}[1 + ({n}):] ELSE {w} END"


def keyed_sql(src: str, line: str = "line") -> str:
    """SELECT of ``src`` with ``key``: the similar-line key of its column ``line``."""
    lvl = f"(len(w) >= 2 AND regexp_matches(upper(regexp_replace(w[1], '^[\\[\\]:]+|[\\[\\]:]+$', '', 'g')), '^({T.LEVEL_TOKENS})$'))"
    return f"""SELECT *, CASE WHEN contains(k0, ' ') AND regexp_matches(regexp_replace(string_split(k0, ' ')[-1], '^[\\[({{}})\\]]+|[\\[({{}})\\]]+$', '', 'g'), '^[0-9.,/:-]*[0-9][0-9.,/:-]*s?(ms)?%?$')
  THEN regexp_replace(k0, ' [^ ]*$', '') ELSE k0 END AS key FROM (SELECT *, array_to_string(CASE WHEN {lvl} THEN list_prepend(w[1], {_cut_sql('r')}) ELSE {_cut_sql('w')} END, ' ') AS k0
  FROM (SELECT *, w[2:] AS r FROM (SELECT *, string_split({collapse_sql(line)}, ' ') AS w FROM ({src}))))"""


def _folded(keyed: str) -> str:
    return f"""k AS ({keyed}), i AS (SELECT *, CASE WHEN key = lag(key) OVER w2 THEN 0 ELSE 1 END AS s FROM k WINDOW w2 AS (PARTITION BY id ORDER BY line_no)),
  g AS (SELECT *, sum(s) OVER (PARTITION BY id ORDER BY line_no) AS g FROM i),
  f AS (SELECT id, g, arg_min(line, line_no) || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS line FROM g GROUP BY id, g)"""


_SPEC_LINES = "SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM ({src})"


def _trimmed(t: str) -> str:
    return f"SELECT id, line_no, {trim_sql('line')} AS line FROM ({_SPEC_LINES.format(src=_SPEC_SRC.format(t=t))}) WHERE {trim_sql('line')} <> ''"


def _head(h: int) -> str:
    return f"""array_to_string(CASE WHEN len(ls) > {h} THEN list_append(ls[1:{h}], '... +' || (len(ls) - {h}) || ' more lines') ELSE ls END, chr(10))"""


_ALL = "(SELECT capture_id AS id FROM captures) a LEFT JOIN r USING (id) LEFT JOIN (SELECT capture_id AS id, raw_combined IS NULL AS missing FROM captures) m USING (id)"
_LOGS = f"SELECT id, line_no, {trim_sql('line')} AS line FROM ({_LINES.format(src='SELECT capture_id AS id, ' + NO_ANSI + ' AS t FROM captures')}) WHERE {trim_sql('line')} <> ''"
def _sev(src: str) -> str:
    return f"""SELECT *, coalesce(list_filter(list_transform((CASE WHEN len(sw) >= 3 AND regexp_matches(sw[1], '^[0-9]{{4}}(-[0-9]{{2}}-|/[0-9]{{2}}/)[0-9]{{2}}$') AND {_moment_sql('sw[2]')} THEN sw[3:] ELSE {_cut_sql('sw')} END)[1:3],
  lambda t: MAP {{{', '.join(f"'{k}': '{v}'" for k, v in T.SEVERITIES.items())}}}[string_split(lower(regexp_replace(t, '^[\\[\\]()<>:,;|*]+|[\\[\\]()<>:,;|*]+$', '', 'g')), '=')[-1]]), lambda x: x IS NOT NULL)[1], 'other') AS severity
  FROM (SELECT *, string_split({collapse_sql('line')}, ' ') AS sw FROM ({src}))"""


SQL = {
    "token_estimate": f"SELECT doc_id, ({TOKENS.format(t='text')})::BIGINT AS tokens FROM documents WHERE text IS NOT NULL",
    "strip_ansi": f"SELECT capture_id, sha256({NO_ANSI}) AS hash FROM captures WHERE raw_combined IS NOT NULL",
    "compact_lines": f"""WITH {_folded(keyed_sql(_trimmed(NO_ANSI)))}, r AS (SELECT id, list(line ORDER BY g) AS ls FROM f GROUP BY id)
SELECT id AS capture_id, CASE WHEN missing THEN NULL WHEN ls IS NULL THEN '' ELSE {_head(12)} END AS rendered, CASE WHEN NOT missing THEN coalesce(len(ls), 0)::INT END AS total_lines,
 CASE WHEN NOT missing THEN greatest(coalesce(len(ls), 0) - 12, 0)::INT END AS omitted FROM {_ALL}""",
    "interesting_error_lines": f"""WITH l AS ({_SPEC_LINES.format(src=_SPEC_SRC.format(t=NO_ANSI))}), k AS (SELECT * FROM l WHERE {trim_sql('line')} <> '' AND regexp_matches(line, '(?i){'|'.join(L.INTERESTING)}')),
r AS (SELECT id, list(CASE WHEN length(line) > 160 THEN left(line, 160) || '...' ELSE line END ORDER BY line_no) AS ls FROM k GROUP BY id)
SELECT id AS capture_id, CASE WHEN missing THEN NULL WHEN ls IS NULL THEN 'ok' ELSE {_head(12)} END AS rendered, CASE WHEN NOT missing THEN coalesce(len(ls), 0)::INT END AS total_lines,
 CASE WHEN NOT missing THEN greatest(coalesce(len(ls), 0) - 12, 0)::INT END AS omitted FROM {_ALL}""",
    "read_minimal": f"""WITH l AS ({_SPEC_LINES.format(src=_SPEC_SRC.format(t=NO_ANSI))}), k AS (SELECT * FROM l WHERE NOT regexp_matches(line, '^\\s*(//|#)')),
r AS (SELECT id, list(line ORDER BY line_no) AS ls FROM k GROUP BY id)
SELECT id AS capture_id, CASE WHEN missing THEN NULL WHEN ls IS NULL THEN '' ELSE {_head(40)} END AS rendered, CASE WHEN NOT missing THEN coalesce(len(ls), 0)::INT END AS total_lines,
 CASE WHEN NOT missing THEN greatest(coalesce(len(ls), 0) - 40, 0)::INT END AS omitted FROM {_ALL}""",
    "fold_consecutive": f"""WITH {_folded('SELECT *, line AS key FROM (' + _trimmed('raw_combined') + ')')}, r AS (SELECT id, array_to_string(list(line ORDER BY g), chr(10)) AS t, count(*) AS n FROM f GROUP BY id)
SELECT id AS capture_id, CASE WHEN NOT missing THEN sha256(coalesce(t, '')) END AS hash, CASE WHEN NOT missing THEN coalesce(n, 0)::INT END AS total_lines FROM {_ALL}""",
    "fold_similar": f"""WITH {_folded(keyed_sql(_trimmed('raw_combined')))}, r AS (SELECT id, array_to_string(list(line ORDER BY g), chr(10)) AS t, count(*) AS n FROM f GROUP BY id)
SELECT id AS capture_id, CASE WHEN NOT missing THEN coalesce(n, 0)::INT END AS total_lines, CASE WHEN NOT missing THEN sha256(coalesce(t, '')) END AS hash FROM {_ALL}""",
    "head_tail_marker": f"""WITH l AS ({_SPEC_LINES.format(src=_SPEC_SRC.format(t='raw_combined'))}), r AS (SELECT id, list(line ORDER BY line_no) AS ls FROM l WHERE {trim_sql('line')} <> '' GROUP BY id)
SELECT id AS capture_id, CASE WHEN missing THEN NULL WHEN ls IS NULL THEN '' WHEN len(ls) > 8 THEN array_to_string(list_concat(list_append(ls[1:5], '... +' || (len(ls) - 8) || ' more lines'), ls[-3:]), chr(10))
 ELSE array_to_string(ls, chr(10)) END AS rendered, CASE WHEN NOT missing THEN greatest(coalesce(len(ls), 0) - 8, 0)::INT END AS omitted FROM {_ALL}""",
    "keep_strip_filter": f"""WITH l AS ({_SPEC_LINES.format(src=_SPEC_SRC.format(t='raw_combined'))}), r AS (SELECT id, count(*) AS n FROM l WHERE regexp_matches(line, '(?i)fail|error') AND NOT regexp_matches(line, '^\\s*at ') GROUP BY id)
SELECT id AS capture_id, CASE WHEN NOT missing THEN coalesce(n, 0)::INT END AS total_lines FROM {_ALL}""",
    "similar_line_key": f"SELECT key, count(*) AS n FROM ({keyed_sql(_LINES.format(src='SELECT capture_id AS id, raw_combined AS t FROM captures'))}) GROUP BY key",
    "log_template_key": f"""SELECT array_to_string(list_transform(string_split({collapse_sql('line')}, ' '), lambda t: CASE WHEN regexp_matches(t, '^[0-9a-fA-F-]{{8,}}$') AND regexp_matches(t, '[0-9]') THEN '#' ELSE regexp_replace(t, '[0-9]+', 'N', 'g') END), ' ') AS template,
 count(*) AS n FROM ({_LINES.format(src='SELECT capture_id AS id, raw_combined AS t FROM captures')}) GROUP BY 1""",
    "unique_lines_ordered": f"""WITH l AS ({_LINES.format(src='SELECT capture_id AS id, raw_combined AS t FROM captures')}), u AS (SELECT id, {trim_sql('line')} AS line, min(line_no) AS m FROM l WHERE {trim_sql('line')} <> '' GROUP BY ALL),
r AS (SELECT id, count(*) AS n, array_to_string(list(line ORDER BY m), chr(10)) AS t FROM u GROUP BY id) SELECT id AS capture_id, CASE WHEN missing THEN NULL ELSE coalesce(n, 0)::INT END AS n, CASE WHEN NOT missing THEN sha256(coalesce(t, '')) END AS hash FROM {_ALL}""",
    "join_limited_lines": f"""WITH l AS ({_LINES.format(src='SELECT capture_id AS id, raw_combined AS t FROM captures')}), u AS (SELECT id, {trim_sql('line')} AS line, min(line_no) AS m FROM l WHERE {trim_sql('line')} <> '' GROUP BY ALL),
r AS (SELECT id, list(line ORDER BY m) AS ls FROM u GROUP BY id) SELECT id AS capture_id, CASE WHEN ls IS NULL THEN 'ok' ELSE {_head(4)} END AS rendered FROM {_ALL} WHERE NOT missing""",
    "severity_histogram": f"SELECT severity, count(*) AS n FROM ({_sev(_LOGS)}) GROUP BY severity",
    "log_message_dedup": f"""WITH s AS ({_sev(keyed_sql(_LOGS))}), c AS (SELECT *, regexp_extract(line, '([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})', 1) AS clock FROM s),
g AS (SELECT id, severity, key, count(*) AS n, min(line_no)::INT AS first_line, coalesce(arg_min(clock, line_no) FILTER (WHERE clock <> ''), '') AS first_clock, coalesce(arg_max(clock, line_no) FILTER (WHERE clock <> ''), '') AS last_clock, arg_min(line, line_no) AS d FROM c GROUP BY ALL)
SELECT id AS record_id, severity, n, first_line, first_clock, last_clock, CASE WHEN length(d) > 240 THEN left(d, 240) || '...' ELSE d END AS display FROM g""",
}
