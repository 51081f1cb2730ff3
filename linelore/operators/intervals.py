"""Times against intervals of the same entity: shards that hold all a time needs, and step functions over them.

Both tables are cut into shards of one entity and one stretch of time. An interval belongs to every shard that it touches
when widened by the tolerance, so shard edges overlap and no shard has to look into another. Two things keep shards and
copies small whatever the data: an interval longer than LONG stretches goes to a level with stretches LONG times as
wide (a time looks at each level that occurs), and a stretch with more than CROWD rows is halved until its share is below.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 16
CROWD = 1 << 20
FINEST = 10  # halvings of a crowded stretch at most
LOWEST = np.iinfo(np.int64).min // 4


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def sharded(records: DataFrame, record: tuple[Column, Column, Column], intervals: DataFrame, interval: tuple[Column, Column, Column, Column], tolerance_us: int, width_us: int, crowd: int = CROWD) -> tuple[DataFrame, int]:
    """``entity, level, bucket, fine, kind, t, t2, seq, id`` in shards, intervals (kind 0) first, and the number of levels.

    ``record`` is (id, entity, time) and ``interval`` (id, entity, begin, end); rows with a null in one of these and intervals
    that end before they begin are left out.
    """
    r = records.select(record[0].cast("bigint").alias("seq"), record[1].cast("string").alias("entity"), _us(record[2]).alias("t"))
    r = r.where("seq is not null and entity is not null and t is not null")
    i = intervals.select(interval[0].cast("string").alias("id"), interval[1].cast("string").alias("entity"), _us(interval[2]).alias("t"), _us(interval[3]).alias("t2"))
    i = i.where("id is not null and entity is not null and t <= t2").select("*", (F.col("t") - tolerance_us).alias("lo"), (F.col("t2") + tolerance_us).alias("hi"))
    level, width = F.lit(0), width_us
    steps = [width_us]
    while width * LONG < 2**62:
        level = F.when(F.col("hi") - F.col("lo") > F.lit(width * LONG), F.lit(len(steps))).otherwise(level)
        width *= LONG
        steps.append(width)
    i = i.withColumn("level", level.cast("byte"))
    levels = sorted(x[0] for x in i.select("level").distinct().collect())  # at most a dozen
    wide = F.element_at(F.array(*[F.lit(s) for s in steps]), F.col("level") + 1)
    i = i.withColumn("w", wide).select("entity", "level", F.explode(F.sequence(F.floor(F.col("lo") / F.col("w")), F.floor(F.col("hi") / F.col("w")))).alias("bucket"), "w", "lo", "hi", "t", "t2", "id")
    r = r.select("entity", F.explode(F.array(*[F.lit(x).cast("byte") for x in levels or [0]])).alias("level"), "t", "seq").withColumn("w", wide)
    r = r.withColumn("bucket", F.floor(F.col("t") / F.col("w")))
    key = ["entity", "level", "bucket"]
    sizes = i.select(*key).unionByName(r.select(*key)).groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > crowd)
    # at most one row for each CROWD rows of the input
    cuts = sizes.select(*key, F.least(F.ceil(F.log2(F.col("rows") / F.lit(float(crowd)))), F.lit(FINEST)).cast("int").alias("cut"))
    part = lambda c: F.floor((c - F.col("bucket") * F.col("w")) / (F.col("w") / F.pow(F.lit(2), F.col("cut")).cast("bigint")))
    last = F.pow(F.lit(2), F.col("cut")).cast("bigint") - 1
    i = i.join(F.broadcast(cuts), key, "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    i = i.withColumn("fine", F.explode(F.sequence(F.greatest(F.lit(0), part(F.col("lo"))), F.least(last, part(F.col("hi"))))))
    r = r.join(F.broadcast(cuts), key, "left").withColumn("cut", F.coalesce("cut", F.lit(0))).withColumn("fine", F.least(last, part(F.col("t"))))
    none = F.lit(None)
    i = i.select(*key, "fine", F.lit(0).cast("byte").alias("kind"), "t", "t2", none.cast("bigint").alias("seq"), "id")
    r = r.select(*key, "fine", F.lit(1).cast("byte").alias("kind"), "t", F.lit(0).cast("bigint").alias("t2"), "seq", none.cast("string").alias("id"))
    both = i.unionByName(r).repartition(*key, "fine").sortWithinPartitions(*key, "fine", "kind")
    return both, max(1, len(levels))


class Steps:
    """The step function of one shard: between two neighbouring ends of intervals nothing changes.

    ``starts`` are the steps' first times, ``inside`` the place of the containing interval with the latest begin (ties by
    ``tie``, the smallest first), ``depth`` how many contain the step, ``left`` the last one that ended before and
    ``right`` the next one that begins; -1 for none. Places refer to ``first``, ``last`` and ``ids``.
    """

    def __init__(self, first: np.ndarray, last: np.ndarray, ids: list[str], tie: Callable[[int], tuple] | None = None):
        keys = [(int(first[i]), (tie(i) if tie else ()), ids[i]) for i in range(len(ids))]
        order = sorted(range(len(ids)), key=keys.__getitem__)
        self.first, self.last, self.ids = first[order], last[order], [ids[i] for i in order]
        rank = [keys[i][1:] for i in order]
        f, la, n = self.first.tolist(), self.last.tolist(), len(ids)
        self.starts = np.unique(np.concatenate([[LOWEST], self.first, self.last + 1]))
        inside = np.full(len(self.starts), -1, np.int64)
        heap: list[tuple] = []
        j = 0
        for k, b in enumerate(self.starts.tolist()):
            while j < n and f[j] <= b:
                heapq.heappush(heap, (-f[j], rank[j], j))
                j += 1
            while heap and la[heap[0][2]] < b:
                heapq.heappop(heap)
            if heap:
                inside[k] = heap[0][2]
        self.inside = inside
        self.depth = np.searchsorted(self.first, self.starts, "right") - np.searchsorted(np.sort(self.last), self.starts, "left")
        by_end = sorted(range(n), key=lambda i: (la[i], f[i], -i))  # of equal ends the latest begin, then the first of its rank, is last
        k = np.searchsorted(self.last[by_end], self.starts, "left") - 1
        self.left = np.where(k >= 0, np.array(by_end)[np.maximum(k, 0)], -1)
        r = np.searchsorted(self.first, self.starts, "right")
        self.right = np.where(r < n, r, -1)

    def step(self, t: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, t, "right") - 1


def shards(batches: Iterator[pa.RecordBatch], make: Callable[[np.ndarray, np.ndarray, list[str]], object]) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The records of each shard of ``sharded`` rows, slice by slice, with what ``make`` builds of the shard's intervals."""
    shard: tuple | None = None
    parts: list[tuple] = []
    made = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        d = b.column("entity").dictionary_encode()
        e, kind = d.indices.to_numpy(zero_copy_only=False), b.column("kind").to_numpy()
        cols = [b.column(c).to_numpy() for c in ("level", "bucket", "fine")]
        new = (e[1:] != e[:-1]) | (kind[1:] != kind[:-1])
        for c in cols:
            new |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        t, t2 = b.column("t").to_numpy(), b.column("t2").to_numpy()
        for i, j in zip(bounds, bounds[1:]):
            now = (d.dictionary[int(e[i])].as_py(), *(int(c[i]) for c in cols))
            if now != shard:
                shard, parts, made = now, [], None
            if kind[i] == 0:
                parts.append((t[i:j], t2[i:j], b.column("id").slice(i, j - i).to_pylist()))
                continue
            if not parts:
                continue
            if made is None:
                made = make(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [x for p in parts for x in p[2]])
            yield made, b.slice(i, j - i)


def containing(records: DataFrame, record: tuple[Column, Column, Column], intervals: DataFrame, interval: tuple[Column, Column, Column, Column], slack_s: float = 0, shard_s: int = 86_400, crowd: int = CROWD) -> DataFrame:
    """``record_id, interval_id, n``: each record with the interval around it that began last, and how many there are.

    Intervals are widened by the slack on both sides; of equal begins the latest end, then the smallest id counts. Records
    outside of all intervals are left out; repeated records count once.
    """
    slack = int(slack_s * 1_000_000)
    both, levels = sharded(records, record, intervals, interval, slack, int(shard_s * 1_000_000), crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(first: np.ndarray, last: np.ndarray, ids: list[str]) -> Steps:
            return Steps(first - slack, last + slack, ids, lambda i: (-int(last[i]),))

        for s, b in shards(batches, make):
            at = s.step(b.column("t").to_numpy())
            hit = np.flatnonzero(s.inside[at] >= 0)
            if len(hit):
                k = s.inside[at[hit]]
                yield pa.record_batch([b.column("seq").take(pa.array(hit)), pa.array([s.ids[x] for x in k.tolist()]), pa.array(s.first[k]), pa.array(s.last[k]), pa.array(s.depth[at[hit]])], names=["record_id", "interval_id", "first", "last", "n"])

    found = both.mapInArrow(run, "record_id bigint, interval_id string, first bigint, last bigint, n bigint")
    best = F.min_by("interval_id", F.struct(-F.col("first"), -F.col("last"), F.col("interval_id"))).alias("interval_id")
    return found.groupBy("record_id").agg(best, (F.sum("n") if levels > 1 else F.max("n")).alias("n"))
