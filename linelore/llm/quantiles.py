"""Exact percentiles of groups over very large columns.

The partial result of any part of the data is its table of values with counts; parts (days, files) are combined by adding
counts, so nothing is lost. From such a table percentiles are read by a full distributed sort: the table is ordered by
group and value over ranges and written once, each partition counts its first and last group (only those can go on in a
neighbour) and those of more than HELD values, running sums of these few rows are the groups' offsets, and each partition
then locates the target places that fall into it. A group of any size is cut over as many partitions as it needs, and a
task keeps at most HELD of a group's values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linelore.session import cut_lineage, shuffle_width

HELD = 1 << 20  # values of a group that a task may keep in memory


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The combinable partial result: ``groups, value, n``. Null values aren't counted; null groups are groups."""
    return df.where(F.col(f"`{value}`").isNotNull()).groupBy(*[F.col(f"`{g}`").cast("string").alias(g) for g in groups], F.col(f"`{value}`").alias("value")).agg(F.count("*").alias("n"))


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    """One partial result from several."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    groups = [c for c in out.columns if c != "n"]
    return out.groupBy(*groups).agg(F.sum("n").alias("n"))


def _starts(b: pa.RecordBatch | pa.Table, k: int) -> np.ndarray:
    """Whether a row begins a new group, from the second row on."""
    new = np.zeros(max(0, b.num_rows - 1), dtype=bool)
    for i in range(k):
        col = b.column(i)
        d = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        x = pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False)
        new |= x[1:] != x[:-1]
    return new


def _totals(k: int, held: int):
    """Counts of a partition's first and last group, and of every group with more than ``held`` values in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None  # key, n, rows, whether it is the partition's first
        pid = None
        out: list[list] = []
        for b in batches:
            if not b.num_rows:
                continue
            pid = b.column(k + 2)[0].as_py()
            n = b.column(k + 1).to_numpy()
            at = np.array([0, *(np.flatnonzero(_starts(b, k)) + 1).tolist()])
            sums, rows = np.add.reduceat(n, at), np.diff(np.append(at, b.num_rows))
            for i in [0, *(np.flatnonzero(rows[1:-1] > held) + 1).tolist(), *([len(at) - 1] if len(at) > 1 else [])]:
                key = tuple(b.column(c)[int(at[i])].as_py() for c in range(k))
                if open_ is not None and i == 0 and open_[0] == key:
                    open_[1] += int(sums[i])
                    open_[2] += int(rows[i])
                    continue
                if open_ is not None and (open_[3] or open_[2] > held):
                    out.append(open_)
                open_ = [key, int(sums[i]), int(rows[i]), open_ is None]
        if open_ is not None:
            out.append(open_)
        if out:
            cols = [pa.array([r[0][i] for r in out], pa.string()) for i in range(k)]
            yield pa.record_batch([*cols, pa.array([pid] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.int64())], names=[*[f"g{i}" for i in range(k)], "pid", "n"])

    return run


def ranks(n: np.ndarray, p: float, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (from 1) below and above the percentile of n values, and the share of the upper one."""
    if method == "nearest":
        scaled = round(p * 1000)
        r = np.maximum(1, (n * scaled + 99_999) // 100_000)
        return r, r, np.zeros(len(n))
    x = (n - 1) * (p / 100.0)
    lo = np.floor(x).astype(np.int64)
    return lo + 1, np.minimum(lo + 2, n), x - lo


def _locate(k: int, ps: Sequence[float], method: str):
    """The values at the target places of each group, as far as they lie in this partition.

    A group whose total is known is read place by place as its rows pass; any other one lies whole in this partition and
    has at most ``HELD`` values, which are kept until it ends.
    """
    names = [*[f"g{i}" for i in range(k)], "n", *[f"q{j}_{s}" for j in range(len(ps)) for s in ("lo", "hi")]]

    def places(total: np.ndarray) -> list[np.ndarray]:
        return [r for p in ps for r in ranks(total, p, method)[:2]]

    def inner(t: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        """Of rows that hold whole groups, which begin at ``at``."""
        v, n = t.column(k).to_numpy(), t.column(k + 1).to_numpy()
        cum, ends = np.cumsum(n), np.append(at[1:], len(n)) - 1
        base = cum[at] - n[at]
        total = cum[ends] - base
        out = [t.column(i).take(pa.array(at)) for i in range(k)] + [pa.array(total)]
        out += [pa.array(v[np.searchsorted(cum, base + r, "left")].astype(np.float64)) for r in places(total)]
        return pa.record_batch(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        off, total, seen = 0, -1, 0
        found: list[float | None] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def take(v: np.ndarray, n: np.ndarray) -> None:
            nonlocal seen
            if total < 0:
                held.append((v, n))
                return
            cum = np.cumsum(n)
            for i, r in enumerate(places(np.array([total]))):
                local = int(r[0]) - off - seen
                if 1 <= local <= cum[-1]:
                    found[i] = float(v[np.searchsorted(cum, local, "left")])
            seen += int(cum[-1])

        def close() -> pa.RecordBatch:
            size, answer = total, found
            if size < 0:
                v, n = (np.concatenate(x) for x in zip(*held))
                cum = np.cumsum(n)
                size = int(cum[-1])
                answer = [float(v[np.searchsorted(cum, r[0], "left")]) for r in places(np.array([size]))]
            return pa.record_batch([*[pa.array([x], pa.string()) for x in key], pa.array([size], pa.int64()), *[pa.array([x], pa.float64()) for x in answer]], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            at = np.array([0, *(np.flatnonzero(_starts(b, k)) + 1).tolist()])
            v, n = b.column(k).to_numpy(), b.column(k + 1).to_numpy()
            known = pc.fill_null(b.column(k + 4), -1).to_numpy()[at]
            # groups inside the batch in one go; its first and last one, and those with a known total, one by one
            alone = np.flatnonzero(known >= 0).tolist()
            stops = sorted({0, len(at) - 1, *alone})
            ends = np.append(at[1:], b.num_rows)
            for x, i in enumerate(stops):
                now = tuple(b.column(c)[int(at[i])].as_py() for c in range(k))
                if key is None or now != key or i > 0:
                    if key is not None:
                        yield close()
                    key, total, seen, held, found = now, int(known[i]), 0, [], [None] * (2 * len(ps))
                    off = int(pc.fill_null(b.column(k + 3), 0)[int(at[i])].as_py())
                take(v[at[i] : ends[i]], n[at[i] : ends[i]])
                if x + 1 < len(stops) and stops[x + 1] > i + 1:
                    j = stops[x + 1]
                    yield inner(b.slice(int(ends[i]), int(at[j] - ends[i])), at[i + 1 : j] - ends[i])
        if key is not None:
            yield close()

    return run


def percentiles(counts: DataFrame, groups: Sequence[str], ps: Sequence[float], method: str = "nearest", held: int = HELD) -> DataFrame:
    """``groups, n, p<..>``: percentiles of the values of a partial result, exact whatever its size.

    ``method`` is ``nearest`` (the value at place ceil(n*p/100)) or ``linear`` (between the neighbouring places (n-1)*p/100).
    Values are numbers and come out as doubles (exact up to 2^53). Ties and repeated values are counted as often as they
    occur; a group of one value has it as every percentile; no rows give no groups.
    """
    if method not in ("nearest", "linear"):
        raise ValueError(f"unknown method {method}")
    k, width = len(groups), shuffle_width(counts.sparkSession)
    g = [f"g{i}" for i in range(k)]
    src = counts.select(*[F.col(f"`{c}`").cast("string").alias(a) for c, a in zip(groups, g)], F.col("value"), F.col("n").cast("bigint").alias("n"))
    ordered = src.repartitionByRange(width, *g, "value").sortWithinPartitions(*g, "value").withColumn("pid", F.spark_partition_id())
    ordered = cut_lineage(ordered)  # read twice below: the ranges must be the same ones both times
    gs = ", ".join(f"{x} string" for x in g)
    edges = ordered.mapInArrow(_totals(k, held), f"{gs}, pid int, n bigint")  # two rows a partition and one for each HELD values
    w = Window.partitionBy(*g)
    edges = edges.withColumn("total", F.sum("n").over(w)).withColumn("off", F.sum("n").over(w.orderBy("pid")) - F.col("n"))
    edges = edges.select(*[F.col(x).alias(f"e_{x}") for x in g], F.col("pid").alias("e_pid"), "off", "total")
    same = F.col("pid") == F.col("e_pid")
    for x in g:
        same &= F.col(x).eqNullSafe(F.col(f"e_{x}"))
    placed = ordered.join(F.broadcast(edges), same, "left").select(*g, "value", "n", "pid", "off", "total")
    qs = [f"q{j}_{s}" for j in range(len(ps)) for s in ("lo", "hi")]
    located = placed.mapInArrow(_locate(k, list(ps), method), f"{gs}, n bigint, " + ", ".join(f"{q} double" for q in qs))
    one = located.groupBy(*g).agg(F.max("n").alias("n"), *[F.max(q).alias(q) for q in qs])
    out = []
    for j, p in enumerate(ps):
        lo, hi = F.col(f"q{j}_lo"), F.col(f"q{j}_hi")
        if method == "linear":
            x = (F.col("n") - 1) * F.lit(p / 100.0)
            lo = lo + (hi - lo) * (x - F.floor(x))
        out.append(lo.alias(f"p{p:g}".replace(".", "_")))
    return one.select(*[F.col(a).alias(c) for a, c in zip(g, groups)], "n", *out)
