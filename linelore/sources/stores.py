"""Small stores beside a history: totals, the index of earlier outputs, diagnostics events, project rules, files found by name."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelore.operators import history as H
from linelore.schema import DEDUP_ENTRY
from linelore.sources.jsonl import decode, raw_lines

INDEX_ENTRIES, INDEX_BYTES = 1500, 512 << 10
EVENT = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("detail", T.StringType())])
HEAD_BYTES, TAIL_BYTES = 8 << 20, 64 << 10


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The archived totals: one JSON document with the counters; missing ones are 0."""
    kinds = {"savings_pct_sum": T.DoubleType()}
    schema = T.StructType([T.StructField(k, kinds.get(k, T.LongType())) for k in H.counters()])
    return spark.read.schema(schema).json(path, multiLine=True).select(*[F.coalesce(k, F.lit(0)).alias(k) for k in H.counters()])


def write_totals(totals: DataFrame, path: str) -> None:
    """One row, written anew; adding is ``history.combine_totals`` of what was read and what is new."""
    totals.select(*H.counters()).coalesce(1).write.mode("overwrite").json(path)


def dedup_index(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the index; unreadable lines are left out."""
    return decode(raw_lines(spark, path), DEDUP_ENTRY).where("status = 'ok'").drop("line", "status", "file_path")


def append_entries(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def compacted(entries: DataFrame, most: int = INDEX_ENTRIES, max_bytes: int = INDEX_BYTES) -> DataFrame:
    """The newest entries up to a number and a size as JSON lines; only as many as may stay are summed in order."""
    newest = entries.orderBy(F.desc_nulls_last("timestamp"), F.desc("raw_hash")).limit(most)
    size = F.octet_length(F.to_json(F.struct(*entries.columns))) + 1
    w = Window.orderBy(F.desc_nulls_last("timestamp"), F.desc("raw_hash")).rowsBetween(Window.unboundedPreceding, 0)
    return newest.withColumn("__run", F.sum(size).over(w)).where(F.col("__run") <= max_bytes).drop("__run")


def latest(index: DataFrame, n: int = 1) -> DataFrame:
    return index.orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).limit(n)


def replaced(index: DataFrame, entries: DataFrame) -> DataFrame:
    """The index with entries of the same id taken over from ``entries``."""
    return index.join(entries.select("id"), "id", "left_anti").unionByName(entries)


def append_events(events: DataFrame, path: str) -> None:
    events.select(*EVENT.names).write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    e = spark.read.schema(EVENT).json(path).where("kind is not null")
    return e if since is None else e.where(F.col("timestamp") >= since)


def outbox(stream: DataFrame, path: str, checkpoint: str, batch_rows: int = 500):
    """Hands the rows of a stream on in files of at most so many rows, each micro-batch once; stops when all there is was sent."""

    def send(batch: DataFrame, n: int) -> None:
        batch.write.option("maxRecordsPerFile", batch_rows).mode("overwrite").json(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_RULE_KEYS = {"profile", "prefix", "all_args", "any_args", "exclude", "cwd_contains"}


def load_rules(folder: str) -> tuple[list[dict], list[str]]:
    """A project's rules from JSON files in the order of their names, for ``route.rule_profiles``; invalid ones become warnings.

    A file holds one rule or a list of them; a later rule of one profile replaces an earlier one.
    """
    rules: dict[str, dict] = {}
    warnings = []
    for p in sorted(Path(folder).glob("*.json")):
        try:
            found = json.loads(p.read_text())
        except ValueError as e:
            warnings.append(f"{p.name}: {e}")
            continue
        for r in found if isinstance(found, list) else [found]:
            bad = "not an object" if not isinstance(r, dict) else f"unknown keys {sorted(set(r) - _RULE_KEYS)}" if set(r) - _RULE_KEYS else "no profile" if not r.get("profile") else "matches everything" if len(r) == 1 else ""
            if bad:
                warnings.append(f"{p.name}: {bad}")
            else:
                rules[r["profile"]] = r
    return list(rules.values()), warnings


def find(spark: SparkSession, root: str, name: str = "*", exclude: Sequence[str] = (), max_depth: int | None = None, least_bytes: int = 0) -> DataFrame:
    """``path, name, bytes, modified``: files below a folder by glob, without folders of the given names; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    f = f.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    parts = F.split(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1), "/")
    f = f.where(F.col("bytes") >= least_bytes)
    if exclude:
        f = f.where(~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in exclude])))
    return f if max_depth is None else f.where(F.size(parts) <= max_depth)


def piped(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, omitted``: whole texts as they come through a pipe: head and tail of very long ones, and how many characters lie between."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    over = F.length("text") - HEAD_BYTES - TAIL_BYTES
    kept = F.concat(F.left("text", F.lit(HEAD_BYTES)), F.lit("\n... [output truncated] ...\n"), F.right("text", F.lit(TAIL_BYTES)))
    return t.select("path", F.when(over > 0, kept).otherwise(F.col("text")).alias("text"), F.greatest(over, F.lit(0)).alias("omitted"))
