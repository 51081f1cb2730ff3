"""Content addresses, earlier equal runs, baselines for differences, artifacts, hints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_S = 30 * 60


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def reference(h: Column) -> Column:
    return F.left(h, F.lit(12))


def previous_within(df: DataFrame, keys: Sequence[str], ts: str, seq: str, window_s: int = WINDOW_S) -> DataFrame:
    """Adds ``prev``: the newest earlier row (as a struct) of the same keys at most ``window_s`` before, null for none.

    Time is cut into stretches of the window's length and each row also goes to the next stretch as context, so no key is
    ever ordered as a whole in one task. Null keys equal each other; rows without time have no earlier row.
    """
    us = window_s * 1_000_000
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(F.struct(*df.columns).alias("r"), t.alias("t"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(seq).alias("s"))
    at = F.floor(F.col("t") / us)
    both = rows.where("t is not null").withColumn("b", F.explode(F.array(F.struct(at.alias("b"), F.lit(True).alias("own")), F.struct((at + 1).alias("b"), F.lit(False).alias("own")))))
    w = Window.partitionBy(*[f"k{i}" for i in range(len(keys))], "b.b").orderBy("t", "s")
    both = both.withColumn("p", F.lag(F.struct("r", "t")).over(w)).where("b.own")
    near = F.when(F.col("t") - F.col("p.t") <= us, F.col("p.r"))
    found = both.select("r.*", near.alias("prev"))
    return found.unionByName(rows.where("t is null").select("r.*", F.lit(None).cast(found.schema["prev"].dataType).alias("prev")))


def exact_repeats(runs: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Runs whose command, directory, exit code and output are those of a run at most half an hour before: ``id, prev_id, ref``."""
    p = previous_within(runs, ["fingerprint", "cwd", "exit_code", "raw_hash"], "ts", "id", window_s)
    return p.where("prev is not null").select("id", F.col("prev.id").alias("prev_id"), reference(F.col("raw_hash")).alias("ref"))


def delta_baselines(runs: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """``id, prev_id``: the newest earlier run of the command in its directory and scope.

    None if that run's exit differs, its stored output is truncated, or the output is the same; an older run doesn't
    stand in for it. ``scope`` and ``truncated`` may be missing from ``runs``: then all have one scope and none is truncated.
    """
    for c, v in (("scope", F.lit("")), ("truncated", F.lit(False))):
        if c not in runs.columns:
            runs = runs.withColumn(c, v)
    p = previous_within(runs, ["fingerprint", "cwd", "scope"], "ts", "id", window_s).where("prev is not null")
    return p.where("prev.exit_code = exit_code and prev.raw_hash <> raw_hash and not coalesce(prev.truncated, false)").select("id", F.col("prev.id").alias("prev_id"))


def line_diff(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """``id, added, removed``: lines of the new text that the old one has fewer of, and the other way round."""
    lines = lambda c: F.split(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\n$", ""), "\n")
    both = F.concat(F.transform(lines(old), lambda x: F.struct(x.alias("line"), F.lit(-1).alias("d"))), F.transform(lines(new), lambda x: F.struct(x.alias("line"), F.lit(1).alias("d"))))
    e = pairs.select("id", F.explode(both).alias("e"))
    g = e.groupBy("id", "e.line").agg(F.sum("e.d").alias("d"))
    return g.groupBy("id").agg(F.sum(F.greatest(F.col("d"), F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))


def excess_lines(pairs: DataFrame, primary: str, other: str) -> DataFrame:
    """``id, line_no, line``: the lines of ``primary`` not matched one for one by lines of ``other``, in order."""

    def numbered(c: str) -> DataFrame:
        e = pairs.select("id", F.posexplode(F.split(F.col(c), "\n")).alias("line_no", "line"))
        return e.withColumn("k", F.row_number().over(Window.partitionBy("id", "line").orderBy("line_no")))

    return numbered(primary).join(numbered(other).drop("line_no"), ["id", "line", "k"], "left_anti").select("id", "line_no", "line")


def orphans(artifacts: DataFrame, index: DataFrame, on: str) -> DataFrame:
    """Artifacts that nothing refers to."""
    return artifacts.join(index.select(on), on, "left_anti")


def verified(artifacts: DataFrame, data: str = "data", stated: str = "artifact_hash") -> DataFrame:
    """Artifacts with ``ok``: whether the bytes have the stated hash."""
    return artifacts.withColumn("ok", F.coalesce(F.sha2(F.col(data), 256) == F.col(stated), F.lit(False)))


def expand(index: DataFrame, artifacts: DataFrame, ref: str) -> DataFrame:
    """The stored bytes of the newest entry that a reference names, with ``ok`` for an unchanged artifact."""
    e = find_reference(index, ref).select("artifact_path", "artifact_hash")
    return verified(artifacts.join(F.broadcast(e), artifacts["path"] == e["artifact_path"]).drop("artifact_path"))


def find_reference(index: DataFrame, ref: str) -> DataFrame:
    """The newest entry whose hash begins with a reference of at least four digits."""
    ref = ref.strip().lower()
    if len(ref) < 4:
        raise ValueError("a reference has at least four digits")
    return index.where(F.startswith("raw_hash", F.lit(ref))).orderBy(F.desc("ts")).limit(1)


def hint_lookup(runs: DataFrame, hints: DataFrame) -> DataFrame:
    """``id, hint_id``: the hint of a run's profile that hasn't expired; one for its fingerprint goes first, then the latest expiry.

    Of the hints for one profile and fingerprint only the one that expires last can win, so each side has one row per
    key and no run is multiplied. Runs without a valid hint are left out; of equal expiries the smallest id counts.
    """
    best = F.min(F.struct((-F.unix_micros(F.col("expires_at").cast("timestamp"))).alias("e"), "hint_id", "expires_at"))
    wide = hints.where("fingerprint is null").groupBy("profile").agg(best.alias("w"))
    fine = hints.where("fingerprint is not null").groupBy("profile", "fingerprint").agg(best.alias("f"))
    m = runs.select("id", "profile", "fingerprint", "ts").join(fine, ["profile", "fingerprint"], "left").join(wide, "profile", "left")
    valid = lambda c: F.when(F.col("ts") < F.col(f"{c}.expires_at"), F.col(f"{c}.hint_id"))
    return m.select("id", F.coalesce(valid("f"), valid("w")).alias("hint_id")).where("hint_id is not null")


def hint_rollback(outcomes: DataFrame, least: int = 5, harmful_pct: float = 20.0) -> DataFrame:
    """Hints that do harm: at least five runs, a fifth of them harmful."""
    g = outcomes.groupBy("hint_id").agg(F.count("*").alias("runs"), F.count_if("harmful").alias("harmful"))
    return g.where((F.col("runs") >= least) & (F.col("harmful") * 100.0 >= harmful_pct * F.col("runs")))
