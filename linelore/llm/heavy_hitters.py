"""Most frequent values of columns with very many distinct values, in bounded memory.

First pass: every partition keeps a space-saving summary of CAPACITY counters per column; summaries are merged in a tree of
FAN_IN, so no task ever holds more than FAN_IN summaries. A counter states the most that its value can occur and by how
much that may be too high; a value missing from a full summary occurs at most as often as the summary's smallest counter.
Every value above n/CAPACITY is sure to survive. Second pass: the survivors that can reach the threshold (at most CAPACITY a
column, so they are broadcast) are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import TaskContext

CAPACITY = 2000
FAN_IN = 16
SUMMARY = T.StructType(
    [T.StructField("field", T.StringType()), T.StructField("node", T.LongType()), T.StructField("item", T.StringType()), T.StructField("count", T.LongType()), T.StructField("err", T.LongType()), T.StructField("floor", T.LongType()), T.StructField("seen", T.LongType())]
)


class Summary:
    """item -> (count, err): count - err <= true occurrences <= count; others occur at most ``floor`` times."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.items, self.floor, self.seen = capacity, {}, 0, 0

    def merge(self, items: dict, floor: int, seen: int) -> None:
        """Adds another summary; exact counts are a summary with floor 0."""
        mine, out = self.items, {}
        for x, (c, e) in mine.items():
            oc, oe = items.get(x, (floor, floor))
            out[x] = (c + oc, e + oe)
        for x, (c, e) in items.items():
            if x not in mine:
                out[x] = (c + self.floor, e + self.floor)
        self.floor += floor
        self.seen += seen
        if len(out) > self.capacity:
            top = sorted(out.items(), key=lambda kv: (-kv[1][0], kv[0]))
            self.floor = max(self.floor, top[self.capacity][1][0])
            out = dict(top[: self.capacity])
        self.items = out

    def rows(self, field: str, node: int) -> list[tuple]:
        return [(field, node, x, c, e, self.floor, self.seen) for x, (c, e) in self.items.items()] or [(field, node, None, 0, 0, self.floor, self.seen)]


def _summarise(fields: Sequence[str], capacity: int):
    schema = pa.schema([("field", pa.string()), ("node", pa.int64()), ("item", pa.string()), ("count", pa.int64()), ("err", pa.int64()), ("floor", pa.int64()), ("seen", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {f: Summary(capacity) for f in fields}
        wait: dict[str, list] = {f: [] for f in fields}

        def flush(f: str) -> None:
            if not wait[f]:
                return
            seen = sum(len(x) for x in wait[f])
            vc = pc.value_counts(pa.chunked_array(wait[f]).drop_null())
            own[f].merge({x: (c, 0) for x, c in zip(vc.field(0).to_pylist(), vc.field(1).to_pylist())}, 0, seen)
            wait[f] = []

        size = 0
        for b in batches:
            for i, f in enumerate(fields):
                wait[f].append(b.column(i))
            size += b.num_rows
            if size >= 65_536:
                size = 0
                for f in fields:
                    flush(f)
        rows = []
        for f in fields:
            flush(f)
            rows += own[f].rows(f, TaskContext.get().partitionId())
        yield pa.record_batch([pa.array(c, x.type) for c, x in zip(zip(*rows), schema)], schema=schema)

    return run


def _join(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Summary(capacity)
        for _, part in pdf.groupby("child", sort=True):
            head = part.iloc[0]
            items = {x: (c, e) for x, c, e in zip(part["item"].tolist(), part["count"].tolist(), part["err"].tolist()) if x is not None}
            s.merge(items, int(head["floor"]), int(head["seen"]))
        return pd.DataFrame(s.rows(pdf["field"].iloc[0], int(pdf["node"].iloc[0])), columns=SUMMARY.names)

    return run


def summaries(df: DataFrame, columns: dict[str, Column], capacity: int = CAPACITY) -> DataFrame:
    """One merged summary per column: ``field, item, count, err, floor, seen``."""
    src = df.select(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(columns.values())])
    level = src.mapInArrow(_summarise(list(columns), capacity), SUMMARY)
    nodes = src.rdd.getNumPartitions()
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        level = level.withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / FAN_IN))
        level = level.groupBy("field", "node").applyInPandas(_join(capacity), SUMMARY)
    return level.drop("node")


def frequent_items(df: DataFrame, columns: dict[str, Column], share: float = 0.01, capacity: int = CAPACITY) -> DataFrame:
    """``field, item, n, n_rows``: every value held by at least ``share`` of all rows, with its exact count.

    Nulls count as rows but not as a value; the empty text is a value. Any number of rows may have the same value. An
    empty table gives no rows. ``capacity`` must be above 1/share.
    """
    if capacity * share <= 1:
        raise ValueError("capacity must be above 1/share")
    s = summaries(df, columns, capacity)
    able = s.where(F.col("item").isNotNull() & (F.col("count") >= F.lit(share) * F.col("seen"))).select(F.col("field").alias("f"), F.col("item").alias("i"), "seen")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("item")) for f, c in columns.items()])).alias("p")).select("p.field", "p.item")
    hit = pairs.join(F.broadcast(able), (F.col("field") == F.col("f")) & (F.col("item") == F.col("i")))
    counted = hit.groupBy("field", "item").agg(F.count("*").alias("n"), F.first("seen").alias("n_rows"))
    return counted.where(F.col("n") >= F.lit(share) * F.col("n_rows"))
