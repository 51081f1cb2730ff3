"""Sessions: stretches of activity of one entity that are separated by pauses.

The plan is a secondary sort by entity and time followed by one linear scan of each partition that keeps a single open
session. The sort is by ranges of (entity, time), so an entity that holds a third of all rows is cut over many
partitions; a session that touches an end of its partition is a fragment, and the fragments (at most two a partition,
whatever the data) are joined by a window afterwards. Sessions and fragments come from one and the same scan, whose
result is written once: range bounds are drawn anew for every exchange, so a second scan might be cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelore.functions.paths import directory
from linelore.session import cut_lineage, shuffle_width


def row_digest(df: DataFrame, leave_out: Sequence[str]) -> list[Column]:
    """Two independent 64-bit digests of all other columns; nulls count as values of their own."""
    cols: list[Column] = []
    for f in df.schema.fields:
        if f.name in leave_out:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.MapType, T.VariantType, T.StructType, T.ArrayType)):
            c = F.to_json(F.struct(c.alias("v")))
        cols.append(c)
    if not cols:
        return [F.lit(0).cast("long"), F.lit(0).cast("long")]
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return [F.xxhash64(nulls, *cols), F.xxhash64(F.lit("second"), *reversed(cols), nulls)]


_SCHEMA = "k0 string, k1 string, t0 long, t1 long, first_seq long, last_seq long, n_records long, edge boolean"


def _scan(gap_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None  # k0, k1, t0, t1, first_seq, last_seq, n, edge
        out_schema = pa.schema([("k0", pa.string()), ("k1", pa.string())] + [(c, pa.int64()) for c in ("t0", "t1", "first_seq", "last_seq", "n_records")] + [("edge", pa.bool_())])
        seen = False
        for b in batches:
            if not b.num_rows:
                continue
            ids = []
            for c in ("k0", "k1"):
                d = b.column(c).dictionary_encode()
                ids.append(pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False))
            t = b.column("t").to_numpy(zero_copy_only=False)
            seq = b.column("seq").to_numpy(zero_copy_only=False)
            new = np.ones(len(t), dtype=bool)
            new[1:] = (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1]) | (t[1:] - t[:-1] > gap_us)
            if open_ is not None:
                k0, k1 = b.column("k0")[0].as_py(), b.column("k1")[0].as_py()
                new[0] = (k0, k1) != (open_[0], open_[1]) or t[0] - open_[3] > gap_us
            at = np.flatnonzero(new)
            done: list[list] = []
            stop = int(at[0]) if len(at) else len(t)
            if open_ is not None and stop:
                open_[3], open_[5], open_[6] = int(t[stop - 1]), int(seq[stop - 1]), open_[6] + stop
            if len(at):
                if open_ is not None:
                    done.append(open_)
                ends = np.append(at[1:], len(t))
                take = pa.array(at)
                k0s, k1s = b.column("k0").take(take), b.column("k1").take(take)
                edge = np.zeros(len(at), dtype=bool)
                edge[0] = not seen
                cols = [k0s, k1s, *(pa.array(x, pa.int64()) for x in (t[at], t[ends - 1], seq[at], seq[ends - 1], ends - at)), pa.array(edge)]
                whole = pa.record_batch(cols, schema=out_schema)
                if done:
                    yield pa.record_batch([pa.array([x[i] for x in done], out_schema.field(i).type) for i in range(8)], schema=out_schema)
                if len(at) > 1:
                    yield whole.slice(0, len(at) - 1)
                last = whole.slice(len(at) - 1, 1).to_pylist()[0]
                open_ = [last[c] for c in out_schema.names]
                seen = True
        if open_ is not None:
            open_[7] = True
            yield pa.record_batch([pa.array([open_[i]], out_schema.field(i).type) for i in range(8)], schema=out_schema)

    return run


def sessionize(
    df: DataFrame,
    entity: Column,
    scope: Column,
    time: Column,
    seq: str = "seq",
    gap_seconds: float = 30 * 60,
) -> DataFrame:
    """One row per session: ``entity, scope, started, ended, duration_ms, n_records, first_seq, last_seq``.

    Rows that are equal in all columns but ``seq`` are one record, with the smallest ``seq``. Rows without entity or time
    are left out; a null scope is a value of its own. A pause of exactly the gap does not divide. Ties in time are
    ordered by ``seq``; an empty table gives an empty result; other columns, whatever their names, only take part in the
    comparison of rows. A null ``seq`` counts as -1.
    """
    h1, h2 = row_digest(df, [seq])
    rows = df.select(
        entity.cast("string").alias("k0"),
        scope.cast("string").alias("k1"),
        F.unix_micros(time.cast("timestamp")).alias("t"),
        h1.alias("h1"),
        h2.alias("h2"),
        F.col(f"`{seq}`").cast("long").alias("seq"),
    ).where("k0 is not null and t is not null")
    records = rows.groupBy("k0", "k1", "t", "h1", "h2").agg(F.coalesce(F.min("seq"), F.lit(-1)).alias("seq"))
    ordered = (
        records.select("k0", "k1", "t", "seq")
        .repartitionByRange(shuffle_width(df.sparkSession), "k0", "k1", "t")
        .sortWithinPartitions("k0", "k1", "t", "seq")
    )
    parts = cut_lineage(ordered.mapInArrow(_scan(int(gap_seconds * 1_000_000)), _SCHEMA))
    whole = parts.where("not edge").drop("edge")
    w = Window.partitionBy("k0", "k1").orderBy("t0")
    ends = parts.where("edge").withColumn("starts", F.coalesce(F.col("t0") - F.lag("t1").over(w) > int(gap_seconds * 1_000_000), F.lit(True)).cast("int"))
    ends = ends.withColumn("island", F.sum("starts").over(w))
    joined = ends.groupBy("k0", "k1", "island").agg(
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1_"),
        F.min_by("first_seq", "t0").alias("first_seq"),
        F.max_by("last_seq", "t1").alias("last_seq"),
        F.sum("n_records").alias("n_records"),
    )
    joined = joined.select("k0", "k1", "t0", F.col("t1_").alias("t1"), "first_seq", "last_seq", "n_records")
    return whole.unionByName(joined).select(
        F.col("k0").alias("entity"),
        F.col("k1").alias("scope"),
        F.timestamp_micros("t0").alias("started"),
        F.timestamp_micros("t1").alias("ended"),
        ((F.col("t1") - F.col("t0")) / 1000).cast("long").alias("duration_ms"),
        "n_records",
        "first_seq",
        "last_seq",
    )


def work_sessions(history: DataFrame, gap_seconds: float = 30 * 60) -> DataFrame:
    """Sessions of run history: one directory and one ``session_scope``."""
    return sessionize(history, directory(F.col("cwd")), F.col("session_scope"), F.col("timestamp"), "seq", gap_seconds)
