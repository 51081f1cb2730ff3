"""Streams: tailing events, running log summaries, windows of sessions, repeats within a time window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linelore.functions import text as X


def tail_json(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """New rows of JSON-lines files as they are added."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).json(path)


def tail_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).withColumnRenamed("value", "line")


def log_summary(lines: DataFrame) -> DataFrame:
    """Counts by severity and message; for output modes complete and update. State is one row per distinct message."""
    clean = X.trim(X.strip_ansi(F.col("line")))
    s = lines.select(clean.alias("line")).where("line <> ''")
    return s.groupBy(X.severity(F.col("line")).alias("severity"), X.similar_line_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"), F.first("line").alias("line"))


def severity_counts(lines: DataFrame) -> DataFrame:
    clean = X.trim(X.strip_ansi(F.col("line")))
    return lines.select(clean.alias("line")).where("line <> ''").groupBy(X.severity(F.col("line")).alias("severity")).agg(F.count("*").alias("n"))


def event_rates(events: DataFrame, ts: str, kind: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by window and kind; later ones than the watermark are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def session_windows(events: DataFrame, ts: str, entity: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a live stream: closed when the watermark passes their gap."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), entity).agg(F.count("*").alias("n_records"), F.max(ts).alias("ended"))
    return g.select(entity, F.col("session_window.start").alias("started"), "ended", "n_records")


REPEATS = T.StructType([T.StructField("id", T.LongType()), T.StructField("prev_id", T.LongType()), T.StructField("seen", T.LongType())])
_STATE = T.StructType([T.StructField("id", T.LongType()), T.StructField("us", T.LongType()), T.StructField("seen", T.LongType())])


def _repeat(window_us: int, expire: bool):
    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, at, seen = state.get if state.exists else (None, None, 0)
        rows = []
        for pdf in parts:
            for i, us in pdf.sort_values(["us", "id"])[["id", "us"]].itertuples(index=False):
                near = at is not None and us - at <= window_us
                seen = seen + 1 if near else 0
                if near:
                    rows.append((int(i), int(last), int(seen)))
                last, at = int(i), int(us)
        state.update((last, at, seen))
        if expire:
            state.setTimeoutDuration(max(1000, window_us // 1000))
        if rows:
            yield pd.DataFrame(rows, columns=REPEATS.names)

    return run


def session_repeats(runs: DataFrame, window_s: int = 1800, expire: bool = True) -> DataFrame:
    """``id, prev_id, seen``: runs of a stream whose content repeats one at most so long before (``hash``, ``ts`` and ``id`` columns).

    State is one row per hash and goes when the window has passed; ``expire`` is False for replays of files to their end,
    which timers would keep going.
    """
    r = runs.select("hash", F.col("id").cast("bigint").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where("us is not null")
    return r.groupBy("hash").applyInPandasWithState(_repeat(window_s * 1_000_000, expire), REPEATS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def write_batches(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends a stream to a folder, each micro-batch exactly once; with ``once`` it stops when all there is was read."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


CHUNK_LINES = T.StructType([T.StructField("stream", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])
_PENDING = T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.LongType())])


def _unchunk(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pending, n = state.get if state.exists else ("", 0)
    for pdf in parts:
        closed = False
        for text, end in pdf.sort_values("seq")[["chunk", "end"]].itertuples(index=False):
            pending += text or ""
            closed = closed or bool(end)
        lines = pending.split("\n")
        pending = "" if closed else lines.pop()
        if closed and lines and lines[-1] == "":
            lines.pop()
        if lines:
            yield pd.DataFrame({"stream": [key[0]] * len(lines), "line_no": range(n + 1, n + 1 + len(lines)), "line": [x.replace("\r", "") for x in lines]})
            n += len(lines)
    state.update((pending, n))


def lines_of_chunks(chunks: DataFrame) -> DataFrame:
    """``stream, line_no, line``: lines of outputs that arrive in chunks, which may divide lines and escapes anywhere.

    ``chunks``: ``stream, seq, chunk, end``; a stream's state is the text behind its last line end, given out when ``end`` is true.
    """
    c = chunks.select("stream", F.col("seq").cast("bigint").alias("seq"), "chunk", F.coalesce("end", F.lit(False)).alias("end"))
    return c.groupBy("stream").applyInPandasWithState(_unchunk, CHUNK_LINES, _PENDING, "append", GroupStateTimeout.NoTimeout)


def reduced_batches(stream: DataFrame, text: str, profile: str, exit_code: str, path: str, checkpoint: str, most: int = 12):
    """Reduces the outputs of a stream by their profiles, micro-batch by micro-batch, and appends what each shows."""
    from linelore.operators.reduce import reduce_texts

    def write(batch: DataFrame, n: int) -> None:
        reduce_texts(batch, text, profile, exit_code, None, most).drop(text).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def preview(stream: DataFrame, n: int) -> DataFrame:
    """The first rows of a stream, for output mode append; nothing more is kept once they are there."""
    return stream.limit(n)
