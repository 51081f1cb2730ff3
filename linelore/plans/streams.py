"""Streaming queries run to their end over the tables' files, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelore.plans.text import SQL as text_sql
from linelore.session import drop_at_exit, shared_folder
from linelore.streaming import streams as S


def _drain(spark, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over all files that are there, written in the shared folder."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    drop_at_exit(spark, base)
    schema = stream.schema

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    drop_at_exit(spark, f"{base}/state", now=True)
    out = spark.read.schema(schema.add("batch", "long")).parquet(f"{base}/out")
    last = out.agg(F.max("batch").alias("b"))
    return out.join(F.broadcast(last), F.col("batch") == F.col("b")).drop("b", "batch") if mode == "complete" else out.drop("batch")


def _read(spark, root: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/{name}.parquet*")


def stream_event_rates(spark, root):
    e = _read(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drain(spark, S.event_rates(e, "ts", "event_type", "1 hour"))


def stream_severity_counts(spark, root):
    c = _read(spark, root, "captures").select(F.explode(F.split(F.col("raw_combined"), "\r?\n")).alias("line"))
    return _drain(spark, S.severity_counts(c))


_LIST = (stream_event_rates, stream_severity_counts)
QUERIES = {f.__name__: f for f in _LIST}
SQL = {
    "stream_severity_counts": text_sql["severity_histogram"],
    "stream_event_rates": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
