"""Queries of the general training-data problems (schema drift, sessions, log entries) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linelore.functions.paths import directory_sql
from linelore.operators import drift, logparse, sessions
from linelore.session import spread_table, table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    changes = drift.schema_changes(spread_table(spark, root, "history_lines"), only=list(drift.ALIASES))
    return changes.select("file_name", "field", "change")


def p1_lifespans(spark: SparkSession, root: str) -> DataFrame:
    return drift.lifespans(drift.footer_catalogue(spread_table(spark, root, "history_lines")))


def p1_records(spark: SparkSession, root: str) -> DataFrame:
    return drift.unified_records(spread_table(spark, root, "history_lines"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return sessions.work_sessions(spread_table(spark, root, "history")).select("first_seq", "last_seq", "n_records")


def p3_sessions(spark: SparkSession, root: str) -> DataFrame:
    return sessions.work_sessions(spread_table(spark, root, "history"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return logparse.found_entries(spread_table(spark, root, "captures"), spread_table(spark, root, "usage_lines"))


def p6_entries(spark: SparkSession, root: str) -> DataFrame:
    return logparse.parse_entries(spread_table(spark, root, "captures"), "capture_id", "raw_combined", "captured_at")


QUERIES = {f.__name__: f for f in (p1_found, p1_lifespans, p1_records, p3_found, p3_sessions, p6_found, p6_entries)}

_FIELD = "CASE " + " ".join(f"WHEN regexp_full_match(path, '{'|'.join(s)}') THEN '{f}'" for f, s in drift.ALIASES.items()) + " END"

_SHAPES = f"""
WITH j AS (SELECT origin, file_no, file_name, CASE WHEN json_valid(raw_line) THEN raw_line::JSON END AS j FROM history_lines),
k AS (SELECT origin, file_no, file_name, j, unnest(json_keys(j)) AS k FROM j WHERE json_type(j) = 'OBJECT'),
l1 AS (SELECT origin, file_no, file_name, k AS path, json_extract(j, '$."' || k || '"') AS v FROM k),
k2 AS (SELECT origin, file_no, file_name, path, v, unnest(json_keys(v)) AS k2 FROM l1 WHERE json_type(v) = 'OBJECT'),
l2 AS (SELECT origin, file_no, file_name, path || '.' || k2 AS path, json_extract(v, '$."' || k2 || '"') AS v FROM k2),
both_ AS (SELECT * FROM l1 WHERE json_type(v) <> 'OBJECT' UNION ALL SELECT * FROM l2),
typed AS (SELECT origin, file_no, file_name, path, {_FIELD} AS field,
  CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type
  FROM both_ WHERE json_type(v) <> 'NULL'),
counted AS (SELECT origin, file_no, file_name, field, path, type, count(*) AS n FROM typed WHERE field IS NOT NULL GROUP BY ALL),
shapes AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY origin, file_no, file_name, field ORDER BY n DESC, path, type) = 1),
files AS (SELECT DISTINCT origin, file_no, file_name FROM history_lines),
grid AS (SELECT f.*, x.field, s.path, s.type FROM files f, (SELECT unnest(['session_scope', 'empty_result', 'delta_ref']) AS field) x
  LEFT JOIN shapes s ON s.origin = f.origin AND s.file_no = f.file_no AND s.file_name = f.file_name AND s.field = x.field),
seen AS (SELECT *, lag(path) OVER w AS p0, lag(type) OVER w AS t0, row_number() OVER w AS ord FROM grid WINDOW w AS (PARTITION BY origin, field ORDER BY file_no, file_name))
"""

SQL = {
    "p1_found": _SHAPES
    + """
SELECT file_name, field, 'added' AS change FROM seen WHERE ord > 1 AND p0 IS NULL AND path IS NOT NULL
UNION ALL SELECT file_name, field, 'removed' FROM seen WHERE ord > 1 AND p0 IS NOT NULL AND path IS NULL
UNION ALL SELECT file_name, field, 'renamed' FROM seen WHERE ord > 1 AND p0 <> path
UNION ALL SELECT file_name, field, 'retyped' FROM seen WHERE ord > 1 AND t0 <> type""",
    "p3_found": f"""
WITH r AS (SELECT * EXCLUDE (seq), min(seq) AS seq FROM history GROUP BY ALL),
d AS (SELECT {directory_sql('cwd')} AS dir, session_scope, "timestamp" AS t, seq FROM r),
s AS (SELECT *, CASE WHEN t - lag(t) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_
      FROM d WHERE dir IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY dir, session_scope ORDER BY t, seq)),
g AS (SELECT *, sum(new_) OVER (PARTITION BY dir, session_scope ORDER BY t, seq) AS g FROM s)
SELECT arg_min(seq, (t, seq)) AS first_seq, arg_max(seq, (t, seq)) AS last_seq, count(*) AS n_records FROM g GROUP BY dir, session_scope, g""",
}
SQL["p3_sessions"] = SQL["p3_found"].replace(
    "SELECT arg_min", "SELECT dir AS entity, session_scope AS scope, min(t) AS started, max(t) AS ended, epoch_us(max(t) - min(t)) // 1000 AS duration_ms, arg_min"
)
# Entries layout by layout: what each program writes, without mining. A layout gives date and clock as text, zone, level, component.
_ESC = r"\x1b(?:\[[0-?]*[ -/]*[@-~]|[\]PX^_][^\x07\x1b]*(?:\x07|\x1b\\)|[ -/]*[0-~])"
_WORD = r"([A-Za-z][\w.-]*)"
_HMS = r"(\d\d:\d\d:\d\d)(?:[.,](\d+))?"
_LV = "(?i:trace|debug|info|notice|warn|warning|error|err|severe|fatal|crit|critical|emerg)"
_NAMED = {  # pattern and what its groups are
    "iso": (rf"^(\d{{4}}[-/]\d\d[-/]\d\d)[T ]{_HMS} ?(Z|UTC|[+-]\d\d:?\d\d)? +({_LV}) +\[{_WORD}\]", "ymd hms f z lv comp"),
    "bar": (rf"^{_HMS} \|-({_LV}) in {_WORD} -", "hms f lv comp"),
    "epoch": (rf"^(\d{{10}})(?:\.(\d+))? {_WORD} ({_LV}) ", "sec f comp lv"),
    "letter": (rf"^([TDIWEF])(\d{{4}}) {_HMS} +\d+ {_WORD}:\d+\]", "lv md hms f comp"),
    "keys": (rf"^time=(\d{{4}}-\d\d-\d\d)T{_HMS}(Z|[+-]\d\d:?\d\d)? level=({_LV}) component={_WORD} ", "ymd hms f z lv comp"),
    "module": (rf"^\[\w{{3}} (\w{{3}} \d\d) {_HMS} (\d{{4}})\] \[{_WORD}:({_LV})\]", "mon hms f y comp lv"),
    "dash": (rf"^(\d{{4}}-\d\d-\d\d) {_HMS} - {_WORD} - ({_LV}) - ", "ymd hms f comp lv"),
    "system": (rf"^(\w{{3}} +\d\d?) {_HMS} \S+ {_WORD}\[\d+\]: <({_LV})>", "mon hms f comp lv"),
    "slash": (rf"^(\d\d/\w{{3}}/\d{{4}}):{_HMS} ([+-]\d\d:?\d\d) {_WORD}/({_LV}):", "dmy hms f z comp lv"),
}
_FIELDS = ("ymd", "dmy", "mon", "y", "md", "sec", "hms", "f", "z", "lv", "comp")


def _layout(name: str) -> str:
    pattern, groups = _NAMED[name]
    names = groups.split()
    cols = ", ".join(f"m.{g} AS {g}" if g in names else f"'' AS {g}" for g in _FIELDS)
    quoted = pattern.replace("'", "''")
    return f"SELECT rid, no, until, {cols} FROM (SELECT rid, no, until, regexp_extract(line, '{quoted}', [{', '.join(repr(g) for g in names)}]) AS m FROM l WHERE regexp_matches(line, '{quoted}'))"


_JSON_LINES = """SELECT rid, no, until, regexp_extract(t, '^(\\d{4}-\\d\\d-\\d\\d)', 1) AS ymd, '' AS dmy, '' AS mon, '' AS y, '' AS md, CASE WHEN regexp_matches(t, '^\\d{13}$') THEN left(t, 10) WHEN regexp_matches(t, '^\\d{10}') THEN left(t, 10) ELSE '' END AS sec,
  regexp_extract(t, '[T ](\\d\\d:\\d\\d:\\d\\d)', 1) AS hms, CASE WHEN regexp_matches(t, '^\\d{13}$') THEN right(t, 3) ELSE regexp_extract(t, '[.,](\\d+)', 1) END AS f, regexp_extract(t, '(Z|[+-]\\d\\d:?\\d\\d)$', 1) AS z, lv, comp
 FROM (SELECT rid, no, until, coalesce(j->>'time', j->>'ts', j->>'timestamp', j->>'@timestamp', '') AS t, coalesce(j->>'level', j->>'lvl', j->>'severity', '') AS lv, coalesce(j->>'name', j->>'logger', j->>'component', j->>'module', '') AS comp
  FROM (SELECT rid, no, until, line::JSON AS j FROM l WHERE line[1] = '{' AND line[-1] = '}' AND json_valid(line))) WHERE t <> '' AND lv <> ''"""
_ENTRIES = f"""r AS (SELECT capture_id AS rid, captured_at AS until, string_split(raw_combined, chr(10)) AS ls FROM captures WHERE raw_combined IS NOT NULL),
l AS (SELECT rid, until, no, rtrim(regexp_replace(regexp_replace(raw, '{_ESC}', '', 'g'), '^[A-Za-z][\\w.-]*-[0-9]+ +\\| ?', ''), ' ' || chr(9) || chr(13)) AS line FROM (SELECT rid, until, unnest(ls) AS raw, generate_subscripts(ls, 1) AS no FROM r)),
m AS ({' UNION ALL '.join(_layout(n) for n in _NAMED)} UNION ALL {_JSON_LINES}),
d AS (SELECT *, CASE WHEN sec <> '' THEN make_timestamp(sec::BIGINT * 1000000) WHEN ymd <> '' THEN TRY_CAST(replace(ymd, '/', '-') || ' ' || hms AS TIMESTAMP) WHEN dmy <> '' THEN try_strptime(dmy || ' ' || hms, '%d/%b/%Y %H:%M:%S')
  WHEN mon <> '' AND y <> '' THEN try_strptime(y || ' ' || regexp_replace(mon, ' +', ' ') || ' ' || hms, '%Y %b %d %H:%M:%S')
  WHEN mon <> '' THEN try_strptime(year(until) || ' ' || regexp_replace(mon, ' +', ' ') || ' ' || hms, '%Y %b %d %H:%M:%S') WHEN md <> '' THEN try_strptime(year(until) || ' ' || md || ' ' || hms, '%Y %m%d %H:%M:%S')
  ELSE date_trunc('day', until) + hms::INTERVAL END AS t0, (rpad(left(f, 6), 6, '0'))::BIGINT AS us, mon <> '' AND y = '' OR md <> '' AS yearless, sec = '' AND ymd = '' AND dmy = '' AND mon = '' AND md = '' AS dayless,
  CASE WHEN regexp_matches(z, '^[+-]') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (substr(z, 2, 2)::INT * 60 + right(z, 2)::INT) ELSE 0 END AS off FROM m),
e AS (SELECT rid, no, CASE WHEN yearless AND t0 + to_microseconds(us) > until THEN t0 - INTERVAL 1 YEAR WHEN dayless AND t0 + to_microseconds(us) > until THEN t0 - INTERVAL 1 DAY ELSE t0 END + to_microseconds(us) - to_minutes(off) AS t,
  CASE WHEN lv IN ('10', 'T') OR lower(lv) = 'trace' THEN 'TRACE' WHEN lv IN ('20', 'D') OR lower(lv) = 'debug' THEN 'DEBUG' WHEN lv IN ('30', 'I') OR lower(lv) IN ('info', 'notice') THEN 'INFO' WHEN lv IN ('40', 'W') OR lower(lv) IN ('warn', 'warning') THEN 'WARN'
   WHEN lv IN ('50', 'E') OR lower(lv) IN ('error', 'err', 'severe') THEN 'ERROR' WHEN lv IN ('60', 'F') OR lower(lv) IN ('fatal', 'crit', 'critical', 'emerg') THEN 'FATAL' END AS level,
  regexp_replace(comp, '\\.(?:go|py|rs|js|ts|java|kt|c|cc|cpp|rb|php|cs|scala|swift)$', '') AS component FROM d WHERE t0 IS NOT NULL),
n AS (SELECT rid, no, level, component, epoch_us(t) // 1000 AS ts_ms, lead(no) OVER (PARTITION BY rid ORDER BY no) AS nxt FROM e WHERE level IS NOT NULL),
x AS (SELECT n.rid, n.no, n.level, n.component, n.ts_ms, max(l.no) AS last_line FROM n JOIN l ON l.rid = n.rid AND l.no >= n.no AND (n.nxt IS NULL OR l.no < n.nxt) WHERE trim(l.line, ' ' || chr(9)) <> '' GROUP BY ALL)"""
_STAMP = """u AS (SELECT line_id, trim("timestamp") AS t, regexp_extract(trim("timestamp"), '^(\\d{4})[-/](\\d\\d)[-/](\\d\\d)[T ](\\d\\d:\\d\\d:\\d\\d)(?:[.,](\\d{1,9}))? ?(Z|UTC|GMT|[+-]\\d\\d:?\\d\\d)?$', ['y', 'm', 'd', 'hms', 'f', 'z']) AS p FROM usage_lines),
v AS (SELECT line_id, CASE WHEN p.y <> '' THEN epoch_ms(TRY_CAST(p.y || '-' || p.m || '-' || p.d || ' ' || p.hms AS TIMESTAMP)) + rpad(left(p.f, 3), 3, '0')::BIGINT
  - CASE WHEN regexp_matches(p.z, '^[+-]') THEN (CASE WHEN p.z[1] = '-' THEN -1 ELSE 1 END) * (substr(p.z, 2, 2)::BIGINT * 60 + right(p.z, 2)::BIGINT) * 60000 ELSE 0 END
  WHEN regexp_matches(t, '^\\d{10}$') THEN t::BIGINT * 1000 WHEN regexp_matches(t, '^\\d{13}$') THEN t::BIGINT WHEN regexp_matches(t, '^\\d{10}\\.\\d{1,9}$') THEN left(t, 10)::BIGINT * 1000 + rpad(substr(t, 12, 3), 3, '0')::BIGINT END AS ts_ms FROM u)"""
SQL["p6_found"] = f"""WITH {_ENTRIES}, {_STAMP}
SELECT 'captures' AS record_table, rid AS record_id, no AS first_line, last_line, ts_ms, level, component FROM x
UNION ALL SELECT 'usage_lines', line_id, 1, 1, ts_ms, '', '' FROM v WHERE ts_ms IS NOT NULL"""
# The islands of every field's shape over the files of its origin; a path that no alias names is a field of its own.
SQL["p1_lifespans"] = _SHAPES.split("counted AS")[0] + """named AS (SELECT * EXCLUDE (field), coalesce(field, path) AS field FROM typed),
counted AS (SELECT origin, file_no, file_name, field, path, type, count(*) AS n FROM named GROUP BY ALL),
shapes AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY origin, file_no, file_name, field ORDER BY n DESC, path, type) = 1),
files AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY file_no, file_name) AS ord, count(*) OVER (PARTITION BY origin) AS n_files FROM (SELECT DISTINCT origin, file_no, file_name FROM history_lines)),
s AS (SELECT f.origin, f.ord, f.n_files, s.field, s.path, s.type FROM shapes s JOIN files f USING (origin, file_no, file_name)),
b AS (SELECT *, CASE WHEN lag(path) OVER w = path AND lag(type) OVER w = type AND lag(ord) OVER w = ord - 1 THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY origin, field ORDER BY ord)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY origin, field ORDER BY ord) AS island FROM b)
SELECT origin, field, min(path) AS path, min(type) AS type, min(ord)::INT AS first_ord, max(ord)::INT AS last_ord, max(n_files) AS n_files FROM g GROUP BY origin, field, island"""
