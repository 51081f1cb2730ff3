"""Mixing sources to target shares of tokens by balanced sampling (the cube method).

The mix is as large as the shares allow: the total is the smallest of ``max_repeats * tokens / share`` over the sources, so
every source reaches its share. A document of a source is then wanted tokens/available tokens times: the whole part as
copies, the fraction as a probability. The flight phase moves these probabilities along the null space of the constraints
(tokens and documents of the source stay what they are) until they are 0 or 1; it runs on every partition, then on what
was left undecided (at most two documents a source and partition) in a tree of FAN_IN, and in the end the landing phase
rounds the last two of each source to the nearest total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linelore.llm.encoding import RANKS, TOKENIZERS, count_tokens
from linelore.session import cut_lineage

FAN_IN = 64
TINY = 1e-9


def flight(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved until at most two are fractional; sum(pi) and sum(pi * size) stay the same."""
    p, s = pi.astype(float).tolist(), size.astype(float).tolist()
    draw = iter(rng.random(len(p)).tolist())
    live: list[int] = []
    for i, x in enumerate(p):
        if TINY < x < 1 - TINY:
            live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        # the null space of (1, 1, 1) and (size_a, size_b, size_c)
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[j]) / d if d > 0 else -p[j] / d for j, d in zip(live, u) if d)
        down = min(p[j] / d if d > 0 else (p[j] - 1) / d for j, d in zip(live, u) if d)
        step = up if next(draw) < down / (up + down) else -down
        for j, d in zip(live, u):
            v = p[j] + d * step
            p[j] = 0.0 if v < TINY else 1.0 if v > 1 - TINY else v
        live = [j for j in live if 0 < p[j] < 1]
    return np.array(p)


def landing(size: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """The last few fractional ones rounded so that the token total is missed least; at most four are tried in all ways."""
    pi = pi.copy()
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    if not len(open_):
        return pi
    want = float((pi[open_] * size[open_]).sum())
    best, best_miss = None, np.inf
    k = len(open_)
    for m in range(1 << k):
        pick = [(m >> j) & 1 for j in range(k)]
        miss = abs(sum(s for s, x in zip(size[open_], pick) if x) - want)
        if miss < best_miss:
            best, best_miss = pick, miss
    pi[open_] = best
    return pi


def _rng(seed: int, *at: int) -> np.random.Generator:
    return np.random.default_rng([seed, *(abs(int(x)) for x in at)])


_SCHEMA = "doc_id bigint, source string, n_tokens bigint, copies int, pi double, node bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64()), ("copies", pa.int32()), ("pi", pa.float64()), ("node", pa.int64())])


def _batch(pdf: pd.DataFrame) -> pa.RecordBatch:
    """With stated types: those of a frame without rows can't be read from it."""
    return pa.RecordBatch.from_pandas(pdf[_ARROW.names], schema=_ARROW, preserve_index=False)


def _first_flight(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str, pd.DataFrame] = {}
        for k, b in enumerate(batches):
            pdf = b.to_pandas()
            if pdf.empty:
                continue
            pid = int(pdf["node"].iloc[0])
            for i, (source, part) in enumerate(pdf.groupby("source", sort=True)):
                part = pd.concat([left.pop(source), part]) if source in left else part
                part = part.assign(pi=flight(part["n_tokens"].to_numpy(), part["pi"].to_numpy(), _rng(seed, pid, k, i)))
                undecided = (part["pi"] > 0) & (part["pi"] < 1)
                if undecided.any():
                    left[source] = part[undecided]
                yield _batch(part[~undecided])
        if left:
            yield _batch(pd.concat(left.values()))

    return run


def _next_flight(seed: int, land: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"])
        size = pdf["n_tokens"].to_numpy()
        pi = flight(size, pdf["pi"].to_numpy(), _rng(seed, pdf["node"].iloc[0], len(pdf)))
        return pdf.assign(pi=landing(size, pi) if land else pi)

    return run


def wanted(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, available, rate``: how often a document of each source is wanted.

    Sources without tokens or without a positive share can't contribute and don't bound the total.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").cast("double").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(have, "source").where("available > 0")
    everywhere = Window.partitionBy(F.lit(1))  # over the mix's few sources
    t = t.withColumn("total", F.min(F.col("max_repeats") * F.col("available") / F.col("target_share")).over(everywhere))
    return t.withColumn("rate", F.least(F.col("total") * F.col("target_share") / F.col("available"), F.col("max_repeats").cast("double")))


def select_mix(documents: DataFrame, targets: DataFrame, seed: int = 7, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """``doc_id, source, n_tokens, repeats``: the selected documents, each with the number of times it is used.

    Null sources, sources that aren't listed, and null, empty and otherwise tokenless texts are not wanted. Equal documents
    under different ids are documents of their own. The same seed and partitions give the same selection.
    """
    sizes = count_tokens(documents.where("source is not null"), ["doc_id", "source"], "text", folder, ranks).where("n_tokens > 0")
    sizes = cut_lineage(sizes.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"))  # the mix's list of sources
    rate = wanted(sizes, targets).select("source", "rate")
    plan = sizes.join(F.broadcast(rate), "source")
    whole = F.floor(F.col("rate") + TINY)
    part = F.col("rate") - whole
    plan = plan.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.col("n_tokens").cast("bigint").alias("n_tokens"), whole.cast("int").alias("copies"), F.when(part > TINY, part).otherwise(0.0).alias("pi"), F.spark_partition_id().cast("bigint").alias("node"))
    state = cut_lineage(plan.mapInArrow(_first_flight(seed), _SCHEMA))  # drawn once: what follows reads it twice
    nodes = first = state.rdd.getNumPartitions()
    open_ = "pi > 0 and pi < 1"
    done = [state.where(f"not ({open_})")]
    rest = state.where(open_)
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        rest = rest.withColumn("node", F.floor(F.col("node") / FAN_IN))
        rest = rest.groupBy("source", "node").applyInPandas(_next_flight(seed, nodes == 1), _SCHEMA)
        if nodes > 1:
            done.append(rest.where(f"not ({open_})"))
            rest = rest.where(open_)
    if first <= 1:
        rest = rest.groupBy("source", "node").applyInPandas(_next_flight(seed, True), _SCHEMA)
    out = rest
    for d in done:
        out = out.unionByName(d)
    out = out.withColumn("repeats", (F.col("copies") + F.col("pi").cast("int")).cast("int")).where("repeats > 0")
    return out.select("doc_id", "source", "n_tokens", "repeats")


def reached_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, share, tokens, documents, most_repeats``: what a selection reaches, a row per wanted source."""
    s = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share")).join(s, "source", "left")
    t = t.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    zero = F.lit(0).cast("bigint")
    return t.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("share"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
