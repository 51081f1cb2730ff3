"""Rows that stand out in tables, and tables and JSON values read from texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelore.functions import text as T

MIN_ROWS, MAX_DISTINCT = 8, 8


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n``: one pass over the table for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def rare_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n``: values of a twentieth of the rows or fewer, in columns of two to eight values; tables of eight rows or more."""
    v = value_counts(df, columns)
    size = v.groupBy("column").agg(F.count("*").alias("distinct"), F.sum("n").alias("rows"))
    v = v.join(F.broadcast(size), "column").where((F.col("rows") >= MIN_ROWS) & F.col("distinct").between(2, MAX_DISTINCT))
    return v.where(F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("rows") / 20))).select("column", "value", "n")


def rare_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that have a rare value, with how rare their rarest one is. Rare values are few (eight a column), so they are broadcast."""
    out, rarity = df, []
    rare = rare_values(df, columns)
    for i, c in enumerate(columns):
        r = rare.where(F.col("column") == c).select(F.col("value").alias(f"__v{i}"), F.col("n").alias(f"__n{i}"))
        out = out.join(F.broadcast(r), F.col(c).cast("string").eqNullSafe(F.col(f"__v{i}")), "left").drop(f"__v{i}")
        rarity.append(F.col(f"__n{i}"))
    least = F.least(*rarity) if len(rarity) > 1 else rarity[0]
    return out.withColumn("rarity", least).drop(*[f"__n{i}" for i in range(len(columns))]).where("rarity is not null")


def anomalies_then_fill(df: DataFrame, columns: Sequence[str], order: str, limit: int) -> DataFrame:
    """A table cut to ``limit`` rows: those with rare values first, rarest ahead, then the leading ones; in the table's order."""
    marked = rare_rows(df, columns).select(order, "rarity")
    picked = df.join(marked, order, "left").orderBy(F.col("rarity").isNull(), "rarity", order).limit(limit)
    return picked.orderBy(order)


def status_breakdown(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def minority_rows(df: DataFrame, status: str) -> DataFrame:
    """The rows whose status isn't the one that more than half of them have; none if no status has."""
    s = status_breakdown(df, status).agg(F.max_by("status", "n").alias("top"), F.max("n").alias("most"), F.sum("n").alias("rows")).where("most * 2 > rows")
    return df.join(F.broadcast(s.select("top")), F.col(status).eqNullSafe(F.col("top")) == F.lit(False)).drop("top")


def key_sets(df: DataFrame, json: Column) -> DataFrame:
    """``keys, n``: the sorted keys of JSON objects and how often they occur; other values count as null."""
    keys = F.array_join(F.array_sort(F.json_object_keys(json)), ",")
    return df.groupBy(keys.alias("keys")).agg(F.count("*").alias("n"))


def dominant_key_set(df: DataFrame, json: Column) -> DataFrame:
    """The most frequent set of keys (of equal ones the smallest) and its share."""
    k = key_sets(df, json).where("keys is not null")
    return k.agg(F.min_by("keys", F.struct(-F.col("n"), "keys")).alias("keys"), F.max("n").alias("n"), (F.max("n") / F.sum("n")).alias("share"))


def json_profile(df: DataFrame, column: str) -> DataFrame:
    """``key, type, n, least, greatest``: what a column of JSON objects holds at its first level."""
    src = df.select(F.try_parse_json(F.col(column)).alias("v"))
    e = df.sparkSession.sql("SELECT a.key, schema_of_variant(a.value) AS type, try_variant_get(a.value, '$', 'string') AS value FROM {src} s, LATERAL variant_explode(s.v) a", src=src)
    return e.groupBy("key", "type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))


# The order in which the keys of an object are shown: keys as they are, then endings and parts of keys. Fixed values.
KEY_NAMES = (
    ("id", "ids", "uuid", "uid", "ocid", "arn", "name", "displayname", "display_name", "title", "slug"),
    ("status", "state", "phase", "health", "healthstatus", "health_status", "severity", "level"),
    ("timestamp", "time", "createdat", "created_at", "updatedat", "updated_at", "modifiedat", "modified_at"),
    ("error", "errors", "message", "reason", "code", "description"),
)
KEY_PARTS = ((4, r"id$"), (5, "name"), (6, "status|state"), (7, "time|date"), (8, "error|message|reason"))


def key_priority(key: Column) -> Column:
    """0 to 3 for names, states, times and errors, 4 to 8 for keys that hold such a part, else 100."""
    k = F.lower(F.translate(key, "- ", "__"))
    out = F.lit(100)
    for n, part in reversed(KEY_PARTS):
        out = F.when(k.rlike(part), n).otherwise(out)
    for n, names in reversed(list(enumerate(KEY_NAMES))):
        out = F.when(k.isin(*names), n).otherwise(out)
    return out


def wide_table(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id, row_no, cells``: lines cut at tabs or two and more spaces; texts whose lines have fewer than two cells give none."""
    cells = lambda x: F.filter(F.transform(F.split(x, r"\t+|\s{2,}"), T.trim), lambda c: c != "")
    rows = F.filter(F.transform(F.split(F.regexp_replace(T.strip_ansi(F.col(text)), "\r", ""), "\n"), lambda x: cells(T.trim(x))), lambda c: F.size(c) >= 2)
    return df.select(F.col(record_id).alias("record_id"), F.posexplode(rows).alias("row_no", "cells"))


def delimiter(lines: Column) -> Column:
    """The first of pipe, tab and comma that two thirds of the lines hold; null for none."""
    share = lambda d: F.size(F.filter(lines, lambda x: x.contains(d))) * 3 >= F.size(lines) * 2
    return F.when(F.size(lines) == 0, F.lit(None)).when(share("|"), "|").when(share("\t"), "\t").when(share(","), ",")


def sql_line_kind(line: Column) -> Column:
    """noise, border, error, summary or row: of the output of a database client."""
    t = T.trim(line)
    return (
        F.when((t == "") | t.rlike(r"(?i)^(?:timing is|output format is|using database)"), "noise").when(t.rlike(r"^[+|\-=\s]+$"), "border")
        .when(t.rlike(r"(?i)^(?:error|fatal|panic)\b|syntax error"), "error").when(t.rlike(r"(?i)^\(?\d+ rows?\b|^(?:INSERT|UPDATE|DELETE|SELECT) \d+"), "summary").otherwise("row")
    )


def json_routing(c: Column) -> Column:
    """json for one value, ndjson if every line that isn't blank is a value (two lines or more), text for others."""
    t = T.trim(c)
    shaped = lambda x: F.try_parse_json(x).isNotNull() & x.rlike(r"^[{\[]")
    ls = F.filter(F.transform(F.split(t, "\n"), T.trim), lambda x: x != "")
    return F.when(shaped(t), "json").when((F.size(ls) > 1) & F.forall(ls, shaped), "ndjson").otherwise("text")
