"""Queries over tables, JSON values, paths and diffs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from linelore.operators import lines as L
from linelore.operators import search as S
from linelore.operators import tables as B
from linelore.plans.text import NO_ANSI_PATTERN
from linelore.session import table

_OC = ["o_orderstatus", "o_orderpriority"]
_LC = ["l_returnflag", "l_linestatus", "l_linenumber"]
_HC = ["profile_confidence", "exit_code", "verifier_repairs"]


def rare_values_history(spark, root):
    return B.rare_values(table(spark, root, "history"), _HC)


def rare_value_rows_orders(spark, root):
    return B.rare_rows(table(spark, root, "orders"), _OC).select("o_orderkey", "rarity")


def rare_value_rows_lineitem(spark, root):
    return B.rare_rows(table(spark, root, "lineitem"), _LC).select("l_orderkey", "l_linenumber", "rarity")


def rare_value_rows_history(spark, root):
    return B.rare_rows(table(spark, root, "history"), _HC).select("seq", "rarity")


def anomalies_then_fill(spark, root):
    return B.anomalies_then_fill(table(spark, root, "history").select("seq", *_HC), _HC, "seq", 40)


def status_breakdown(spark, root):
    return B.status_breakdown(table(spark, root, "orders"), "o_orderstatus")


def minority_status_rows(spark, root):
    return B.minority_rows(table(spark, root, "captures"), "exit_code").select("capture_id", "exit_code")


def dominant_key_set(spark, root):
    return B.dominant_key_set(table(spark, root, "events"), F.col("props"))


def json_props_profile(spark, root):
    return B.json_profile(table(spark, root, "events"), "props").select("key", "n")


def json_record_profile(spark, root):
    return B.json_profile(table(spark, root, "history_lines"), "raw_line")


def json_key_order(spark, root):
    p = B.json_profile(table(spark, root, "history_lines"), "raw_line")
    return p.select("key").distinct().select("key", B.key_priority(F.col("key")).alias("priority"))


def largest_objects_topk(spark, root):
    d = table(spark, root, "documents").where("n_chars is not null")
    return d.orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


def size_totals(spark, root):
    d = table(spark, root, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("largest"))


def wide_table_rows(spark, root):
    r = B.wide_table(table(spark, root, "captures"), "capture_id", "raw_combined")
    return r.groupBy("record_id", F.size("cells").alias("width")).agg(F.count("*").alias("n"))


def sql_output_delimiter(spark, root):
    d = table(spark, root, "documents").where("text is not null").withColumn("ls", L.reducer_lines(F.col("text")))
    return d.select("doc_id", B.delimiter(F.col("ls")).alias("delimiter"))


def json_routing(spark, root):
    return table(spark, root, "history_lines").groupBy(B.json_routing(F.col("raw_line")).alias("route")).agg(F.count("*").alias("n"))


def search_group_by_file(spark, root):
    m = S.matches(table(spark, root, "documents").withColumn("file", F.concat_ws("/", "source", "doc_id")), "file", "text", r"release|contract")
    return S.group_by_file(m)


def path_inventory_dir_ext(spark, root):
    return S.inventory(table(spark, root, "usage_lines"), "file_path")


def search_noise_buckets(spark, root):
    p = table(spark, root, "usage_lines").select(F.col("file_path").alias("p")).unionByName(table(spark, root, "history").select(F.col("cwd").alias("p")))
    return p.groupBy(S.noise_bucket(F.col("p")).alias("bucket")).agg(F.count("*").alias("n"))


def diff_stats(spark, root):
    return S.diff_stats(table(spark, root, "documents"), "doc_id", "text")


def path_tree(spark, root):
    return S.tree(table(spark, root, "history").where("cwd is not null"), "cwd")


_LIST = (rare_values_history, rare_value_rows_orders, rare_value_rows_lineitem, rare_value_rows_history, anomalies_then_fill, status_breakdown, minority_status_rows, dominant_key_set, json_props_profile, json_record_profile, json_key_order, largest_objects_topk, size_totals, wide_table_rows, sql_output_delimiter, json_routing, search_group_by_file, path_inventory_dir_ext, search_noise_buckets, diff_stats, path_tree)
QUERIES = {f.__name__: f for f in _LIST}


def _rare(t: str, cols: list[str]) -> str:
    v = " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::VARCHAR AS value, count(*) AS n FROM {t} GROUP BY {c}" for c in cols)
    return f"""v AS ({v}), s AS (SELECT col, count(*) AS d, sum(n) AS r FROM v GROUP BY col),
rare AS (SELECT v.col, v.value, v.n FROM v JOIN s USING (col) WHERE r >= 8 AND d BETWEEN 2 AND 8 AND n <= greatest(1, r // 20))"""


def _rows(t: str, cols: list[str], keys: str) -> str:
    joins = " ".join(f"LEFT JOIN rare r{i} ON r{i}.col = '{c}' AND r{i}.value IS NOT DISTINCT FROM x.{c}::VARCHAR" for i, c in enumerate(cols))
    least = f"least({', '.join(f'r{i}.n' for i in range(len(cols)))})"
    return f"WITH {_rare(t, cols)} SELECT {keys}, {least} AS rarity FROM {t} x {joins} WHERE {least} IS NOT NULL"


_PROFILE = """j AS (SELECT {c}::JSON AS j FROM {t} WHERE json_valid({c}) AND json_type({c}) = 'OBJECT'), k AS (SELECT j, unnest(json_keys(j)) AS key FROM j)"""
_EXT = r"lower(regexp_extract(string_split(p, '/')[-1], '.(\.[A-Za-z0-9]+)$', 1))"
# Every node with its parent's number of children; a node is merged into the line above it or begins one (a head).
_TREE = """WITH p AS (SELECT DISTINCT list_filter(string_split(cwd, '/'), lambda x: x NOT IN ('', '.')) AS s FROM history WHERE cwd IS NOT NULL),
e AS (SELECT DISTINCT s[1:i] AS node FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM p)),
n AS (SELECT node, (SELECT count(*) FROM e c WHERE len(c.node) = len(e.node) + 1 AND c.node[1:len(e.node)] = e.node) AS kids,
 (SELECT count(*) FROM e c WHERE len(c.node) = len(e.node) AND c.node[1:len(e.node) - 1] = e.node[1:len(e.node) - 1]) AS sib FROM e),
m AS (SELECT *, sib = 1 AND kids > 0 AND len(node) > 1 AS merged FROM n),
t AS (SELECT node, (SELECT count(*) FROM m h WHERE NOT h.merged AND h.node = x.node[1:len(h.node)]) AS depth,
 (SELECT arg_max(c.node, len(c.node)) FROM m c WHERE c.merged AND c.node[1:len(x.node)] = x.node AND len(c.node) > len(x.node)
   AND (SELECT bool_and(h.merged) FROM m h WHERE len(h.node) > len(x.node) AND h.node = c.node[1:len(h.node)])) AS stop FROM m x WHERE NOT merged)"""
SQL = {
    "rare_values_history": f"WITH {_rare('history', _HC)} SELECT col AS column, value, n FROM rare",
    "rare_value_rows_orders": _rows("orders", _OC, "o_orderkey"),
    "rare_value_rows_lineitem": _rows("lineitem", _LC, "l_orderkey, l_linenumber"),
    "rare_value_rows_history": _rows("history", _HC, "seq"),
    "anomalies_then_fill": _rows("history", _HC, "seq").replace("WITH ", "WITH m AS (WITH ", 1) + f") SELECT h.seq, {', '.join('h.' + c for c in _HC)}, m.rarity FROM history h LEFT JOIN m USING (seq) ORDER BY m.rarity IS NULL, m.rarity, h.seq LIMIT 40",
    "status_breakdown": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
    "minority_status_rows": "WITH s AS (SELECT exit_code, count(*) AS n FROM captures GROUP BY 1), t AS (SELECT arg_max(exit_code, n) AS top FROM s HAVING max(n) * 2 > sum(n)) SELECT capture_id, exit_code FROM captures, t WHERE exit_code IS DISTINCT FROM top",
    "dominant_key_set": "WITH k AS (SELECT array_to_string(list_sort(json_keys(props)), ',') AS keys, count(*) AS n FROM events GROUP BY 1) SELECT arg_min(keys, (-n, keys)) AS keys, max(n) AS n, max(n)::DOUBLE / sum(n) AS share FROM k WHERE keys IS NOT NULL",
    "json_props_profile": f"WITH {_PROFILE.format(c='props', t='events')} SELECT key, count(*) AS n FROM k GROUP BY key",
    "largest_objects_topk": "SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 10",
    "size_totals": "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS largest FROM documents GROUP BY source",
    "search_group_by_file": """WITH e AS (SELECT concat_ws('/', source, doc_id) AS file, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT file, count(*) AS n, min(line_no)::INT AS first_line, left(arg_min(line, line_no), 160) AS text FROM e WHERE regexp_matches(line, 'release|contract') GROUP BY file""",
    "path_inventory_dir_ext": """WITH p AS (SELECT DISTINCT file_path AS p FROM usage_lines WHERE file_path IS NOT NULL), s AS (SELECT p, string_split(p, '/') AS s FROM p)
SELECT 'dir' AS kind, CASE WHEN len(s) > 1 THEN array_to_string(s[:-2], '/') || '/' ELSE './' END AS value, count(*) AS n FROM s GROUP BY 2
UNION ALL SELECT 'top', CASE WHEN len(s) > 1 THEN s[1] || '/' ELSE '.' END, count(*) FROM s GROUP BY 2
UNION ALL SELECT 'ext', CASE WHEN contains(s[-1], '.') THEN '.' || lower(string_split(s[-1], '.')[-1]) ELSE '[no-ext]' END, count(*) FROM s GROUP BY 2""",
    "search_noise_buckets": """WITH p AS (SELECT string_split(file_path, '/') AS s FROM usage_lines UNION ALL SELECT string_split(replace(replace(cwd, '//', '/'), '//', '/'), '/') FROM history)
SELECT list_filter(s, lambda x: x IN ('.git', '.next', '.turbo', '.cache', '__pycache__', 'build', 'coverage', 'dist', 'node_modules', 'target', 'vendor'))[1] AS bucket, count(*) AS n FROM p GROUP BY 1""",
    "diff_stats": """SELECT doc_id AS record_id, len(list_filter(ls, lambda x: starts_with(x, 'diff --git ')))::INT AS files, len(list_filter(ls, lambda x: starts_with(x, '@@ ')))::INT AS hunks,
 len(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')))::INT AS added, len(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')))::INT AS removed
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)""",
    "path_tree": _TREE + " SELECT array_to_string(node, '/') AS dir, depth::INT AS depth, repeat('  ', depth::INT) || CASE WHEN stop IS NULL THEN node[-1] ELSE array_to_string(stop[len(node):], '/') || '/' END AS label FROM t",
    "json_key_order": f"""WITH {_PROFILE.format(c='raw_line', t='history_lines')}, n AS (SELECT DISTINCT key, lower(replace(replace(key, '-', '_'), ' ', '_')) AS k FROM k)
SELECT key, CASE WHEN k IN ('id', 'ids', 'uuid', 'uid', 'ocid', 'arn', 'name', 'displayname', 'display_name', 'title', 'slug') THEN 0 WHEN k IN ('status', 'state', 'phase', 'health', 'healthstatus', 'health_status', 'severity', 'level') THEN 1
 WHEN k IN ('timestamp', 'time', 'createdat', 'created_at', 'updatedat', 'updated_at', 'modifiedat', 'modified_at') THEN 2 WHEN k IN ('error', 'errors', 'message', 'reason', 'code', 'description') THEN 3
 WHEN ends_with(k, 'id') THEN 4 WHEN contains(k, 'name') THEN 5 WHEN contains(k, 'status') OR contains(k, 'state') THEN 6 WHEN contains(k, 'time') OR contains(k, 'date') THEN 7
 WHEN contains(k, 'error') OR contains(k, 'message') OR contains(k, 'reason') THEN 8 ELSE 100 END AS priority FROM n""",
}
SQL["json_routing"] = """WITH t AS (SELECT regexp_replace(raw_line, '^\\s+|\\s+$', '', 'g') AS t FROM history_lines), l AS (SELECT t, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM t)
SELECT CASE WHEN json_valid(t) AND t[1] IN ('{', '[') THEN 'json' WHEN len(ls) > 1 AND len(list_filter(ls, lambda x: json_valid(x) AND x[1] IN ('{', '['))) = len(ls) THEN 'ndjson' ELSE 'text' END AS route, count(*) AS n FROM l GROUP BY 1"""
_LS = "list_filter(list_transform(string_split(replace({c}, chr(13), ''), chr(10)), lambda x: regexp_replace(x, '[\\s\\x0B]+$', '')), lambda x: x <> '')"
SQL["sql_output_delimiter"] = f"""WITH l AS (SELECT doc_id, {_LS.format(c="regexp_replace(text, '" + NO_ANSI_PATTERN + "', '', 'g')")} AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(ls) = 0 THEN NULL WHEN len(list_filter(ls, lambda x: contains(x, '|'))) * 3 >= len(ls) * 2 THEN '|' WHEN len(list_filter(ls, lambda x: contains(x, chr(9)))) * 3 >= len(ls) * 2 THEN chr(9)
 WHEN len(list_filter(ls, lambda x: contains(x, ','))) * 3 >= len(ls) * 2 THEN ',' END AS delimiter FROM l"""
SQL["wide_table_rows"] = f"""WITH l AS (SELECT capture_id AS record_id, unnest(string_split(replace(regexp_replace(raw_combined, '{NO_ANSI_PATTERN}', '', 'g'), chr(13), ''), chr(10))) AS x FROM captures WHERE raw_combined IS NOT NULL),
c AS (SELECT record_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(x, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'), '\\t+|[\\s\\x0B]{{2,}}'), lambda y: regexp_replace(y, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')), lambda y: y <> ''))::INT AS width FROM l)
SELECT record_id, width, count(*) AS n FROM c WHERE width >= 2 GROUP BY ALL"""
