"""Stored outputs: writing with hashes, keeping ends of long ones, retention by number and size, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER = "\n... [output truncated] ...\n"


def head_and_tail(text: Column, most: int, marker: str = MARKER) -> Column:
    """A text of at most ``most`` characters: its beginning and end around a marker."""
    room = max(0, most - len(marker))
    head = room // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(room - head)))).otherwise(text)


def with_hashes(df: DataFrame, text: str, most: int = 4 << 20) -> DataFrame:
    """Adds ``data, raw_hash, artifact_hash, truncated, ref``."""
    data = F.encode(head_and_tail(F.col(text), most), "UTF-8")
    return df.withColumns({"data": data, "raw_hash": F.sha2(F.encode(F.col(text), "UTF-8"), 256), "truncated": F.length(text) > most}).withColumn("artifact_hash", F.sha2("data", 256)).withColumn("ref", F.left("raw_hash", F.lit(12)))


def write(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def pruned(index: DataFrame, max_files: int = 200, max_bytes: int = 256 << 20) -> DataFrame:
    """``id, kept``: the newest artifacts up to a number and a total size; only as many as may stay are summed in order."""
    newest = index.orderBy(F.desc("timestamp"), F.desc("id")).limit(max_files)
    w = Window.orderBy(F.desc("timestamp"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    keep = newest.withColumn("run", F.sum("raw_bytes").over(w)).where(F.col("run") <= max_bytes).select("id", F.lit(True).alias("k"))
    return index.select("id").join(F.broadcast(keep), "id", "left").select("id", F.coalesce("k", F.lit(False)).alias("kept"))


def search(index: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Artifacts whose id, path, command, profile or directory holds a text, newest first."""
    hay = F.lower(F.concat_ws("\n", "id", "path", "command", "profile", "cwd"))
    return index.where(F.contains(hay, F.lit(query.lower()))).orderBy(F.desc("timestamp"), "id").limit(limit)


def find(index: DataFrame, ref: str) -> DataFrame:
    """By exact id, else by file name, else by prefix of the id; the newest."""
    name = F.substring_index("path", "/", -1)
    rank = F.when(F.col("id") == ref, 0).when(name == ref, 1).when(F.startswith("id", F.lit(ref)), 2)
    return index.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.desc("timestamp")).limit(1).drop("rank")
