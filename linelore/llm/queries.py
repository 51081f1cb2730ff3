"""Queries of the corpus problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelore.functions.fingerprint import resolved_fingerprint
from linelore.functions.paths import directory_sql
from linelore.llm import encoding, heavy_hitters, mixing, nearest_time, quantiles, runs, subjects
from linelore.session import spread_table, table


def _timings(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "history").where("duration_ms >= 0")
    return h.select("profile", resolved_fingerprint(F.col("command_fingerprint"), F.col("command")).alias("command_fingerprint"), "duration_ms", F.to_date("timestamp").alias("day"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return nearest_time.session_of_record(table(spark, root, "history"), table(spark, root, "session_usage"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    groups = ["profile", "command_fingerprint"]
    p = quantiles.percentiles(quantiles.value_counts(_timings(spark, root), groups, "duration_ms"), groups, [50, 95])
    return p.where("n >= 30 and p95 > 8 * p50").select(*groups)


def p4_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Medians and high percentiles per group, from the days' partial results combined."""
    groups = ["profile", "command_fingerprint"]
    days = quantiles.value_counts(_timings(spark, root), ["day", *groups], "duration_ms")
    return quantiles.percentiles(quantiles.combine([days.drop("day")]), groups, [50, 90, 95, 99])


def p4_profiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles per profile, between neighbouring places."""
    return quantiles.percentiles(quantiles.value_counts(_timings(spark, root), ["profile"], "duration_ms"), ["profile"], [50, 95], "linear")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return runs.found_runs(spread_table(spark, root, "captures"))


def p5_collapsed(spark: SparkSession, root: str) -> DataFrame:
    return runs.collapsed(spread_table(spark, root, "captures"), "capture_id", "raw_combined")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "history").select(resolved_fingerprint(F.col("command_fingerprint"), F.col("command")).alias("fp"), "command")
    return heavy_hitters.frequent_items(h, {"command_fingerprint": F.col("fp"), "command": F.col("command")}).select("field", "item")


def p7_counts(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "history").select(resolved_fingerprint(F.col("command_fingerprint"), F.col("command")).alias("fp"), "command")
    return heavy_hitters.frequent_items(h, {"command_fingerprint": F.col("fp"), "command": F.col("command")})


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return encoding.encode(spread_table(spark, root, "documents"), ["doc_id"])


def p8_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, n_chars``: the length of each text after encoding and decoding."""
    return encoding.decode(encoding.encode(spread_table(spark, root, "documents").where("text is not null"), ["doc_id"]), ["doc_id"]).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("hash"))


def p8_tree(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, leaves, joins``: how many pieces each text was reduced from."""
    return encoding.tree_size(spread_table(spark, root, "documents"), ["doc_id"])


def p9_selection(spark: SparkSession, root: str) -> DataFrame:
    return mixing.select_mix(spread_table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.reached_shares(p9_selection(spark, root), table(spark, root, "mix_targets"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return subjects.document_subjects(spread_table(spark, root, "documents"), table(spark, root, "subject_labels"), table(spark, root, "subjects"))


def p10_composition(spark: SparkSession, root: str) -> DataFrame:
    """``subject, documents``: how many documents each subject area has."""
    return p10_found(spark, root).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p4_found, p4_percentiles, p4_profiles, p5_found, p5_collapsed, p7_found, p7_counts, p8_ids, p8_round_trip, p8_tree, p9_selection, p9_shares, p10_found, p10_composition)
}

# The fingerprint of a command: lower case, single spaces, FNV-1a of 64 bits (arithmetic in 128-bit integers).
_FP = """CASE WHEN command_fingerprint IS NOT NULL THEN command_fingerprint ELSE lower(lpad(to_hex((list_reduce(list_prepend(
  14695981039346656037::HUGEINT, list_transform(string_split(lower(trim(regexp_replace(command, '\\s+', ' ', 'g'))), ''), lambda c: ord(c)::HUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616))::UBIGINT), 16, '0')) END"""

_RANKED = f"""
WITH t AS (SELECT profile, {_FP} AS command_fingerprint, duration_ms AS v FROM history WHERE duration_ms >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY profile, command_fingerprint ORDER BY v) AS k, count(*) OVER (PARTITION BY profile, command_fingerprint) AS n FROM t),
q AS (SELECT profile, command_fingerprint, n, {', '.join(f'max(v) FILTER (WHERE k = (n * {p} + 99) // 100)::DOUBLE AS p{p}' for p in (50, 90, 95, 99))} FROM r GROUP BY profile, command_fingerprint, n)
"""

SQL = {
    "p2_found": f"""
WITH cur AS (SELECT session_id, {directory_sql('cwd')} AS dir, first_seen, last_seen FROM session_usage
  WHERE session_id IS NOT NULL AND last_seen IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY last_seen DESC, first_seen DESC, {directory_sql('cwd')} DESC NULLS LAST) = 1),
h AS (SELECT seq, {directory_sql('cwd')} AS dir, "timestamp" AS t FROM history WHERE session_scope IS NULL),
p AS (SELECT seq, session_id, first_seen, greatest(0, epoch_us(first_seen) - epoch_us(t), epoch_us(t) - epoch_us(last_seen)) AS dist FROM h JOIN cur USING (dir)
  WHERE t >= first_seen - INTERVAL 120 SECOND AND t <= last_seen + INTERVAL 120 SECOND)
SELECT seq, session_id FROM p QUALIFY row_number() OVER (PARTITION BY seq ORDER BY dist, first_seen DESC, session_id) = 1""",
    "p4_found": _RANKED + "SELECT profile, command_fingerprint FROM q WHERE n >= 30 AND p95 > 8 * p50",
    "p4_percentiles": _RANKED + "SELECT * FROM q",
    "p4_profiles": "SELECT profile, count(*) AS n, quantile_cont(duration_ms::DOUBLE, 0.5) AS p50, quantile_cont(duration_ms::DOUBLE, 0.95) AS p95 FROM history WHERE duration_ms >= 0 GROUP BY profile",
    "p7_counts": f"""
WITH t AS (SELECT {_FP} AS fp, command FROM history),
c AS (SELECT 'command_fingerprint' AS field, fp AS item, count(*) AS n FROM t WHERE fp IS NOT NULL GROUP BY fp
  UNION ALL SELECT 'command', command, count(*) FROM t WHERE command IS NOT NULL GROUP BY command)
SELECT field, item, n, (SELECT count(*) FROM t) AS n_rows FROM c WHERE n >= 0.01 * (SELECT count(*) FROM t)""",
    "p8_round_trip": "SELECT doc_id, length(text) AS n_chars, sha256(text) AS hash FROM documents WHERE text IS NOT NULL",
}
# Lines that repeat one another, by the statement's own words: an engine without look-around, one sign after the other.
_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_HEX = "|".join([*(f"[a-f]{{{i}}}[0-9][0-9a-f]{{{5 - i},}}" for i in range(6)), "[a-f]{6,}[0-9][0-9a-f]*"])
_KEYS = "line"
for _p, _r in (
    (r"\x1B(?:\[[0-?]*[ -/]*[@-~]|[\]PX^_][^\x07\x1B]*(?:\x07|\x1B\\)|[ -/]*[0-~])", ""),
    (rf"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? +({_MON}\b)", r"\1"),
    (rf"\b{_MON}( +[0-9]|/[0-9])", r"\1"),
    (r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b", "\x01"),
    (rf"\b(?:{_HEX})\b", "\x01"),
    ("[0-9]+(?:[.,:][0-9]+)*", "\x01"),
    (r"[ \t\x0B\f\r]+", " "),
):
    _KEYS = f"regexp_replace({_KEYS}, '{_p}', '{_r}', 'g')"
_RUNS = f"""WITH l AS (SELECT capture_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT capture_id, string_split(raw_combined, chr(10)) AS ls FROM captures)),
k AS (SELECT capture_id, pos, line, trim({_KEYS}) AS key FROM l),
s AS (SELECT *, CASE WHEN key = lag(key) OVER w THEN 0 ELSE 1 END AS fresh FROM k WHERE key <> '' WINDOW w AS (PARTITION BY capture_id ORDER BY pos)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY capture_id ORDER BY pos) AS run FROM s)"""
SQL["p5_found"] = _RUNS + " SELECT capture_id, min(pos) AS first_line, max(pos) AS last_line FROM g GROUP BY capture_id, run HAVING count(*) >= 3"
_CLOCK = "(?:^|[^0-9])([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])(?:[.,]([0-9][0-9]?[0-9]?))?"
_PART = "regexp_extract(line, '" + _CLOCK + "', {})"
_MS = f"CASE WHEN regexp_matches(line, '{_CLOCK}') THEN (({_PART.format(1)}::INT * 60 + {_PART.format(2)}::INT) * 60 + {_PART.format(3)}::INT) * 1000 + rpad({_PART.format(4)}, 3, '0')::INT END"
SQL["p5_collapsed"] = _RUNS + f""", c AS (SELECT *, {_MS} AS ms FROM g),
r AS (SELECT capture_id AS seq_id, min(pos) AS first_line, max(pos) AS last_line, count(*) AS n, arg_min(struct_pack(line := line, ms := ms), pos) AS a, arg_max(struct_pack(ms := ms), pos) AS z FROM c GROUP BY capture_id, run)
SELECT seq_id, first_line, last_line, n, CASE WHEN n > 1 THEN ((z.ms - a.ms) % 86400000 + 86400000) % 86400000 END::BIGINT AS duration_ms, a.line AS line FROM r"""
# Leaves of halving a text of n characters until no piece has more than 256.
SQL["p8_tree"] = """WITH RECURSIVE t AS (SELECT DISTINCT coalesce(length(text), 0) AS n, coalesce(length(text), 0) AS piece, 1::BIGINT AS k FROM documents
 UNION ALL SELECT n, p, sum(k)::BIGINT FROM (SELECT n, unnest([piece // 2, piece - piece // 2]) AS p, k FROM t WHERE piece > 256) GROUP BY n, p),
l AS (SELECT n, sum(k)::BIGINT AS leaves FROM t WHERE piece <= 256 AND n > 0 GROUP BY n)
SELECT doc_id, coalesce(leaves, 0) AS leaves, greatest(coalesce(leaves, 0) - 1, 0) AS joins FROM documents LEFT JOIN l ON l.n = coalesce(length(text), 0)"""
SQL["p7_found"] = f"SELECT field, item FROM ({SQL['p7_counts']})"
