"""Pairing records with the interval of the same entity that lies nearest in time.

Both tables are cut into shards of one entity and one stretch of time whose edges overlap. Within a shard the answer
is a step function of time: between two neighbouring ends of intervals the containing interval, the last one that ended
and the next one that begins don't change. The steps' starts are one sorted array; a piecewise-linear index over it
predicts the place of a time with an error of at most EPS, and a binary search in that window gives it exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelore.functions.paths import directory
from linelore.operators.intervals import CROWD, LOWEST, Steps, sharded, shards

EPS = 8
__all__ = ["LOWEST", "LearnedIndex", "nearest_interval", "session_of_record"]


class LearnedIndex:
    """Line segments over a sorted array of distinct keys; each key's place is predicted to within EPS."""

    def __init__(self, keys: np.ndarray, eps: int = EPS):
        self.keys, self.eps = keys, eps
        ks = keys.tolist()
        first, base, slope = [], [], []
        i, n = 0, len(ks)
        while i < n:  # shrinking cone
            k0, lo, hi, j = ks[i], 0.0, float("inf"), i + 1
            while j < n:
                dx = ks[j] - k0
                a, b = (j - i - eps) / dx, (j - i + eps) / dx
                if a > hi or b < lo:
                    break
                lo, hi = max(lo, a), min(hi, b)
                j += 1
            first.append(k0)
            base.append(i)
            slope.append(0.0 if j == i + 1 else (lo + hi) / 2)
            i = j
        self.first, self.base, self.slope = np.array(first, np.int64), np.array(base, np.int64), np.array(slope)
        self.end = np.append(self.base[1:], n) - 1

    def predecessor(self, t: np.ndarray) -> np.ndarray:
        """Place of the last key that isn't above t; every t must be at or above the first key."""
        s = np.searchsorted(self.first, t, "right") - 1
        guess = self.base[s] + np.rint(self.slope[s] * (t - self.first[s])).astype(np.int64)
        guess = np.clip(guess, self.base[s], self.end[s])
        n = len(self.keys)
        lo, hi = np.clip(guess - self.eps - 1, 0, n - 1), np.clip(guess + self.eps + 2, 1, n)
        off = (self.keys[lo] > t) | ((hi < n) & (self.keys[np.minimum(hi, n - 1)] <= t))
        lo, hi = np.where(off, 0, lo), np.where(off, n, hi)  # rounding of very far keys: the whole array instead
        while True:
            go = hi - lo > 1
            if not go.any():
                return lo
            mid = (lo + hi) // 2
            right = go & (self.keys[np.minimum(mid, n - 1)] <= t)
            lo, hi = np.where(right, mid, lo), np.where(go & ~right, mid, hi)


class Nearest(Steps):
    """The nearest interval at each time: the containing one, or of the neighbours on both sides the nearer."""

    def __init__(self, first: np.ndarray, last: np.ndarray, ids: list[str]):
        super().__init__(first, last, ids)
        self.index = LearnedIndex(self.starts)

    def nearest(self, t: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of the nearest interval for each time, -1 where none is near enough, and its distance."""
        at = self.index.predecessor(t)
        inside, left, right = self.inside[at], self.left[at], self.right[at]
        far = np.iinfo(np.int64).max
        dl = np.where(left >= 0, t - self.last[left], far)
        dr = np.where(right >= 0, self.first[right] - t, far)
        out = np.where(dr <= dl, right, left)  # at equal distance the later begin
        d = np.minimum(dl, dr)
        out = np.where(d <= tolerance, out, -1)
        return np.where(inside >= 0, inside, out), np.where(inside >= 0, 0, d)


def _pair(tolerance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, b in shards(batches, Nearest):
            t = b.column("t").to_numpy()
            k, d = s.nearest(t, tolerance)
            hit = np.flatnonzero(k >= 0)
            if len(hit):
                k = k[hit]
                ids = pa.array([s.ids[x] for x in k.tolist()], pa.string())
                yield pa.record_batch([b.column("seq").take(pa.array(hit)), ids, b.column("entity").take(pa.array(hit)), pa.array(t[hit]), pa.array(d[hit]), pa.array(s.first[k])], names=["record_id", "interval_id", "entity", "t", "d", "first"])

    return run


def nearest_interval(
    records: DataFrame,
    record: tuple[Column, Column, Column],
    intervals: DataFrame,
    interval: tuple[Column, Column, Column, Column],
    tolerance_s: float = 120,
    shard_s: int = 86_400,
    crowd: int = CROWD,
) -> DataFrame:
    """``record_id, interval_id``: each record with the nearest interval of its entity within the tolerance.

    ``record`` is (id, entity, time), ``interval`` is (id, entity, begin, end). The distance is 0 from begin to end,
    outside of that the time to the nearer end. Of several intervals the nearest, then the latest begin, then the
    smallest id counts. Records and intervals with a null in one of these columns, and intervals that end before they
    begin, match nothing; repeated records are all answered; an empty side gives an empty result. A directory that holds
    a third of the rows is spread over its shards of ``shard_s`` seconds, and these are cut further where they are crowded.
    """
    tol = int(tolerance_s * 1_000_000)
    both, levels = sharded(records, record, intervals, interval, tol, int(shard_s * 1_000_000), crowd)
    found = both.mapInArrow(_pair(tol), "record_id bigint, interval_id string, entity string, t bigint, d bigint, first bigint")
    if levels > 1:  # very long intervals answer on a level of their own
        key = ["record_id", "entity", "t"]
        found = found.groupBy(*key, "interval_id", "d", "first").agg(F.count("*").alias("n"))
        found = found.groupBy(*key).agg(F.min(F.struct("d", -F.col("first"), "interval_id", "n")).alias("s"))
        found = found.select("record_id", F.col("s.interval_id").alias("interval_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), "s.n")))
    return found.select("record_id", "interval_id")


def current_sessions(usage: DataFrame) -> DataFrame:
    """The row with the latest ``last_seen`` of each session; of equal ones the latest ``first_seen``, then the greatest directory."""
    newest = F.max(F.struct("last_seen", "first_seen", directory(F.col("cwd")).alias("dir"))).alias("s")
    return usage.where("session_id is not null and last_seen is not null").groupBy("session_id").agg(newest).select("session_id", "s.first_seen", "s.last_seen", "s.dir")


def session_of_record(history: DataFrame, usage: DataFrame, tolerance_s: float = 120) -> DataFrame:
    """``seq, session_id`` of the history rows without ``session_scope``."""
    h = history.where("session_scope is null")
    s = current_sessions(usage)
    out = nearest_interval(h, (F.col("seq"), directory(F.col("cwd")), F.col("timestamp")), s, (F.col("session_id"), F.col("dir"), F.col("first_seen"), F.col("last_seen")), tolerance_s)
    return out.select(F.col("record_id").alias("seq"), F.col("interval_id").alias("session_id"))
