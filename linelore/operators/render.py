"""From a captured output to its rendering under a budget: route, reduce, contract, retention, guard, quality.

Each capture is a row; every stage adds columns to it, so a render of any number of captures is one pass without shuffle.
What measures or rewrites whole texts runs in one Arrow pass (``finish``); repeats and changes of earlier runs are joins.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from linelore.functions import text as T
from linelore.functions.tokens import estimate, hard_cap, ultra_compact
from linelore.operators import dedup
from linelore.operators import lines as L
from linelore.operators import route as Ro
from linelore.reducers.base import Output, fit, log_shaped
from linelore.reducers.tools import reduced


@dataclass(frozen=True)
class EngineOptions:
    """Settings that change results, with their defaults."""

    max_preview_lines: int = 12
    reasoning_budget_mode: str = "standard"  # standard, agent or aggressive
    dedup_window_minutes: int = 30
    ultra_compact: bool = False
    verbose: int = 0
    fast_path: bool = True
    compression_contract: bool = True
    retention_verifier: bool = True
    session_dedup: bool = True
    delta_render: bool = True


# Fixed values of budgets and contract.
CONTRACT_RAW, CONTRACT_FLOOR, CONTRACT_PART = 200, 48, 5
TINY_BYTES, TINY_TOKENS = 384, 96
# Outputs that are shown as they are: bytes and tokens by profile, and for any other profile. Fixed values.
FAST_PATH = {
    "ripgrep": (384, 96), "path-find": (384, 96), "generic-summary": (384, 96), "directory-listing": (288, 72), "directory-listing-tree": (384, 96), "grep": (320, 80), "git-diff": (256, 64),
    "git-diff-names": (384, 96), "git-log": (224, 56), "git-ls-files": (384, 96), "git-status": (192, 48), "git-status-short": (288, 72), "ripgrep-files": (384, 96), "ripgrep-files-with-matches": (384, 96),
}
FAST_ANY = (192, 48)
FAILURE_HEAD, DIGEST_LINES = 3, 24
CODE = r"(?<![A-Za-z0-9])[A-Z]{1,3}[0-9]{3,5}(?![A-Za-z0-9])"
CRITICAL = r"FAIL|ERROR|^at |^--> |(?i:^error |error:|error\[|: error |panic:|fatal:|exception|traceback|assertionerror|undefined reference)"


def scale(v: Column, num: int, den: int) -> Column:
    return F.floor((v * num + (den - 1)) / den).cast("int")


def budget_lines(profile: Column, confidence: Column, o: EngineOptions) -> Column:
    """Lines that a render may have: by profile, reasoning mode, verbosity and confidence, each step rounded up."""
    v = F.lit(o.max_preview_lines)
    name = F.coalesce(profile, F.lit(""))
    v = (
        F.when(name.contains("log"), F.greatest(v, F.lit(12)))
        .when(name.isin("ripgrep", "generic-summary", "git-status"), scale(v, 4, 5)).when(name == "python-tooling", scale(F.greatest(v, F.lit(10)), 9, 8))
        .when(name == "pytest", scale(F.greatest(v, F.lit(12)), 5, 4)).when(name.rlike("test|build"), F.greatest(v, F.lit(10))).otherwise(v)
    )
    for on, num, den in ((o.reasoning_budget_mode == "agent", 3, 4), (o.reasoning_budget_mode == "aggressive", 1, 2), (o.ultra_compact, 3, 5), (o.verbose >= 2, 3, 2), (o.verbose == 1, 5, 4)):
        if on:
            v = scale(v, num, den)
    v = F.when(confidence == "low", scale(v, 5, 4)).when(confidence == "medium", scale(v, 9, 8)).otherwise(v)
    return F.least(F.greatest(v, F.lit(3)), F.lit(40))


def allowance(raw_tokens: Column, lines: Column) -> Column:
    """Tokens that a render may have: a fifth of the raw ones and 32 a line, but not under the floor; null for small outputs."""
    a = F.greatest(F.lit(CONTRACT_FLOOR), F.least(F.ceil(raw_tokens / CONTRACT_PART), lines * 32)).cast("int")
    return F.when(raw_tokens >= CONTRACT_RAW, a)


def is_binary(c: Column) -> Column:
    """Whether more than a tenth of a text's first 4096 characters can't be printed. (The sniffed window is the rule's own.)"""
    head = F.left(c, F.lit(4096))
    odd = F.length(F.regexp_replace(head, r"[^\x00-\x08\x0E-\x1A\x1C-\x1F\x7F\uFFFD]", ""))
    return (F.length(head) > 0) & (odd * 10 > F.length(head))


def printable_runs(c: Column) -> Column:
    """Distinct runs of at least eight characters that can be printed."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{Print}\t]{8,}"), F.lit(0)))


def content_route(c: Column) -> Column:
    """empty, binary, log, json or text, by content alone."""
    ls = F.slice(L.reducer_lines(c), 1, 40)
    level = r"^[\[(<]?(?i:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|ERR|FATAL|PANIC|CRITICAL|CRIT)[\])>:]?(?:\s|$)"
    timed = lambda x: T.let(T.collapse(F.concat(x, F.lit(" x"))), lambda y: T.similar_line_key(y) != y)
    dated = r"^\s*[0-9]{4}[-/][0-9]{2}[-/][0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
    log = T.let(ls, lambda x: (F.size(x) >= 5) & (F.size(F.filter(x, lambda y: y.rlike(level) | y.rlike(dated) | timed(y))) * 2 > F.size(x)))
    return F.when(F.coalesce(c, F.lit("")) == "", "empty").when(is_binary(c), "binary").when(log, "log").when(c.rlike(r"^\s*[{\[]"), "json").otherwise("text")


@F.pandas_udf(Ty.StringType())
def hard_cap_tokens(text: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or m is None or m != m else hard_cap(t, int(m)) for t, m in zip(text.where(text.notna(), None), most)], dtype=object)


def fit_priority_lines(cands: Column, max_lines: int, budget: int) -> Column:
    """Positions that are kept, in order, of ``array<struct<tier int, pos int, cost int>>``.

    Tier by tier, then by position; a line that doesn't fit is left out and the next one is tried; tier 0 pays no heed to
    tokens, and the first line always stays. 0 means no limit.
    """
    kept = lambda a: a["kept"]

    def step(a: Column, x: Column) -> Column:
        full = (F.lit(max_lines > 0) & (F.size(kept(a)) >= max_lines)) | (F.lit(budget > 0) & (x["cost"] > a["rem"]) & (F.size(kept(a)) > 0) & (x["tier"] > 0))
        more = F.struct(F.concat(kept(a), F.array(x["pos"])).alias("kept"), (a["rem"] - x["cost"]).cast("int").alias("rem"))
        return F.when(full, a).otherwise(more)

    zero = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(budget).alias("rem"))
    return F.aggregate(F.array_sort(cands), zero, step, lambda a: F.array_sort(kept(a)))


_CRITICAL, _CODE = re.compile(CRITICAL), re.compile(CODE)
_NEEDLE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-][A-Za-z0-9_.-]*\.(?:" + "|".join(T.ANCHOR_EXTENSIONS) + r"):[0-9]+")


def needles(raw: str) -> list[str]:
    """What a render of a failing run must still hold: places (file name and line) and diagnostic codes of critical lines."""
    crit = [x for x in raw.split("\n") if _CRITICAL.search(x.strip())]
    found = [m for x in crit for m in _NEEDLE.findall(x)] + [m for x in crit for m in _CODE.findall(x)]
    return list(dict.fromkeys(found))[:64]


def bypassed(profile: Column, raw: Column, raw_tokens: Column, failed: Column) -> Column:
    """Whether a successful output is so small that it is shown as it is: by the limits of its profile, or tiny."""
    small = lambda lim: (F.octet_length(raw) <= lim[0]) & (raw_tokens <= lim[1])
    by_family = F.lit(False)
    for name, lim in FAST_PATH.items():
        by_family |= (profile == name) & small(lim)
    return ~failed & (F.coalesce(by_family, F.lit(False)) | small(FAST_ANY))


def finished(raw: str, text: str, raw_tokens: int, allowed: int | None, checked: bool, lines: int) -> tuple[str, int, list[str], int]:
    """Contract, small-output guard, retention with repair, and never worse than raw: rendering, its tokens, what was missing, repairs."""
    if allowed is not None and estimate(text) > allowed:
        text = hard_cap(text, allowed) or text
    if len(raw.encode("utf-8", "surrogatepass")) <= TINY_BYTES and raw_tokens <= TINY_TOKENS and estimate(text) > raw_tokens:
        text = raw
    missing = [x for x in needles(raw) if x not in text] if checked else []
    repairs = min(len(missing), lines)
    if repairs:
        text += "\nmissing detail:\n" + "\n".join(missing[:repairs])
    if estimate(text) > raw_tokens:
        text = raw
    return text, estimate(text), missing, repairs


_FINISHED = Ty.StructType([Ty.StructField("route", Ty.StringType()), Ty.StructField("rendered", Ty.StringType()), Ty.StructField("filtered_tokens", Ty.LongType()), Ty.StructField("missing", Ty.ArrayType(Ty.StringType())), Ty.StructField("repairs", Ty.IntegerType())])


_ODD = re.compile("[\x00-\x08\x0e-\x1a\x1c-\x1f\x7f\ufffd]")


def text_route(raw: str) -> str:
    """The same as ``content_route``."""
    if not raw:
        return "empty"
    head = raw[:4096]
    if len(_ODD.findall(head)) * 10 > len(head):
        return "binary"
    if log_shaped(Output(raw).lines):
        return "log"
    return "json" if re.match(r"\s*[{\[]", raw) else "text"


def _finish(ultra: bool):
    def whole(raw, *rest) -> tuple:
        route = text_route(raw or "")
        return (route, *shown(raw or "", route, *rest))

    def shown(raw, route, profile, code, command, fast, raw_tokens, allowed, checked, lines) -> tuple:
        if fast:
            return raw, int(raw_tokens), [], 0
        if route == "binary":
            runs = list(dict.fromkeys(re.findall(r"[\x20-\x7e\t]{8,}", raw)))
            text = "binary, printable: " + " | ".join(runs[:5])
        else:
            text = reduced(raw, profile, 0 if code is None or code != code else int(code), int(lines), command or "")
        out = finished(raw, text, int(raw_tokens), None if allowed is None or allowed != allowed else int(allowed), bool(checked), int(lines))
        if ultra:
            short = ultra_compact(out[0], bool(code))
            return short, estimate(short), out[2], out[3]
        return out

    @F.pandas_udf(_FINISHED)
    def udf(raw: pd.Series, profile: pd.Series, code: pd.Series, command: pd.Series, fast: pd.Series, raw_tokens: pd.Series, allowed: pd.Series, checked: pd.Series, lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([whole(*x) for x in zip(raw, profile, code, command, fast, raw_tokens, allowed, checked, lines)], columns=_FINISHED.names)

    return udf


def render(df: DataFrame, text: str, exit_code: str, profile: str, options: EngineOptions = EngineOptions(), command: Column | None = None, confidence: Column | None = None) -> DataFrame:
    """Adds ``route, raw_tokens, budget_lines, bypassed, rendered, filtered_tokens, saved_tokens, savings_pct, repairs, missing``.

    Stages: small successful outputs as they are; else the reducer of the profile, contract, small-output guard, retention
    and repair, never worse than raw, and one line where ultra-compact is asked for. Null and empty texts render as empty.
    """
    o = options
    df = df.withColumn("__raw", T.trim(T.strip_ansi(F.coalesce(F.col(text), F.lit("")))))
    df = df.withColumn("raw_tokens", T.estimate_tokens(F.col("__raw")))
    df = df.withColumn("budget_lines", budget_lines(F.col(profile), confidence if confidence is not None else F.lit(""), o))
    failed = F.coalesce(Ro.failed(F.col(exit_code), F.col(profile)), F.col(exit_code) != 0, F.lit(False))
    df = df.withColumn("bypassed", F.lit(o.fast_path and not o.ultra_compact) & bypassed(F.col(profile), F.col("__raw"), F.col("raw_tokens"), failed))
    allowed = allowance(F.col("raw_tokens"), F.col("budget_lines")) if o.compression_contract else F.lit(None).cast("int")
    checked = F.lit(o.retention_verifier) & (F.col("raw_tokens") >= CONTRACT_RAW) & failed
    words = command if command is not None else F.lit("")
    # one Arrow pass; it also keeps filters on its results from being worked into everything before
    f = _finish(o.ultra_compact)(F.col("__raw"), F.col(profile), F.col(exit_code), words, F.col("bypassed"), F.col("raw_tokens"), allowed, checked, F.col("budget_lines"))
    df = df.withColumn("__f", f)
    df = df.select(*[c for c in df.columns if c not in ("__f", "__raw")], *[F.col(f"__f.{c}").alias(c) for c in _FINISHED.names])
    saved = F.col("raw_tokens") - F.col("filtered_tokens")
    pct = F.when(F.col("raw_tokens") > 0, F.round(saved * 100.0 / F.col("raw_tokens"), 2)).otherwise(0.0)
    return df.withColumn("saved_tokens", saved).withColumn("savings_pct", pct)


def quality(df: DataFrame, raw: str, rendered: str, exit_code: str, fallback: Column | None = None) -> DataFrame:
    """Adds ``quality``: 100 less penalties for renders that say nothing, lose all failures, fall back, or save little or less than nothing."""
    fell = fallback if fallback is not None else F.lit(0.0)
    place = F.lit(r"(?<![A-Za-z0-9_./-])([A-Za-z0-9_./-]+:[0-9]+(?::[0-9]+)?)")
    before = F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(raw), F.lit("")), place, F.lit(1))), lambda x: x.rlike("[A-Za-z]"))  # not clock times
    after = F.array_distinct(F.regexp_extract_all(F.col(rendered), place, F.lit(1)))
    kept = F.exists(before, lambda b: F.exists(after, lambda a: F.contains(a, b) | F.contains(b, a)))
    lost = (F.col(exit_code) != 0) & (F.size(before) > 0) & ~kept
    actionable = F.size(F.filter(F.split(F.col(rendered), "\n"), lambda x: T.trim(x).rlike(r"\w") & ~x.rlike(r"^\.\.\. \+")))
    raw_t, out_t, saved = F.col("raw_tokens"), F.col("filtered_tokens"), F.col("saved_tokens")
    material = (raw_t >= 96) | (out_t >= 64)
    chance = (raw_t >= 128) | (out_t >= 96) | (saved >= 24)
    tiny = (raw_t < 32) & (out_t < 32) & (-saved <= 4)
    least = F.when((raw_t >= 256) | (out_t >= 192), 10.0).otherwise(8.0)
    low = chance & ~((saved < 0) & tiny) & (F.col("savings_pct") < least)
    used = F.when((fell >= 100) & material, 20).when((fell >= 50) & chance, 10).otherwise(0)
    worse = F.when(saved >= 0, 0).when(tiny, 10).otherwise(40)
    score = 100 - F.when(actionable == 0, 60).otherwise(0) - F.when(lost, 30).otherwise(0) - used - F.when(low, 15).otherwise(0) - worse
    return df.withColumn("quality", F.greatest(F.lit(0), score))


def measure(fixtures: DataFrame, options: EngineOptions = EngineOptions(fast_path=False)) -> DataFrame:
    """``name, profile_name, raw_tokens, filtered_tokens, savings_pct, quality, lost, ok`` of fixtures with their gates.

    ``fixtures``: ``name, profile_name, command, exit_code, text, expected, min_savings, min_quality``; ``lost`` are the
    expected fragments that didn't survive.
    """
    r = render(fixtures, "text", "exit_code", "profile_name", options, F.col("command"))
    r = quality(r, "text", "rendered", "exit_code")
    r = r.withColumn("lost", F.filter("expected", lambda x: ~F.contains(F.col("rendered"), x)))
    ok = (F.size("lost") == 0) & (F.col("savings_pct") >= F.col("min_savings")) & (F.col("quality") >= F.col("min_quality"))
    return r.select("name", "profile_name", "raw_tokens", "filtered_tokens", "savings_pct", "quality", "lost", ok.alias("ok"))


# --- earlier runs -----------------------------------------------------------------------------------------------------


def age(seconds: Column) -> Column:
    """Seconds as the largest whole unit."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0))
    say = lambda d, u: F.concat(F.floor(s / d).cast("string"), F.lit(u))
    return F.when(s < 60, say(1, "s")).when(s < 3600, say(60, "m")).when(s < 86_400, say(3600, "h")).otherwise(say(86_400, "d"))


def reference_render(df: DataFrame, rendered: str, ref: str, seconds: str, count: str, failed: Column) -> DataFrame:
    """Adds ``reference``: the head of a render that is that of an earlier run, and where to find the rest; null if not cheaper.

    The head is the first line, or of a failing run the first critical lines.
    """
    ls = F.filter(F.split(F.coalesce(F.col(rendered), F.lit("")), "\n"), lambda x: T.trim(x) != "")
    critical = F.slice(F.filter(ls, lambda x: T.trim(x).rlike(CRITICAL)), 1, FAILURE_HEAD)
    head = F.when(failed & (F.size(critical) > 0), critical).otherwise(F.slice(ls, 1, 1))
    line = F.concat(F.lit("unchanged from previous run ("), age(F.col(seconds)), F.lit(" ago, x"), F.col(count).cast("string"), F.lit(" identical) [ref: "), F.col(ref), F.lit("]"))
    text = F.array_join(F.concat(head, F.array(line)), "\n")
    return df.withColumn("reference", F.when(T.estimate_tokens(text) < T.estimate_tokens(F.coalesce(F.col(rendered), F.lit(""))), text))


def changed_lines(old: str | None, new: str | None) -> tuple[list[str], list[str]]:
    """Lines of the new text that the old one lacks, and the other way round, counted one for one."""

    def split(t: str | None) -> list[str]:
        return (t or "").removesuffix("\n").split("\n")

    def excess(a: list[str], b: list[str]) -> list[str]:
        left, out = Counter(b), []
        for x in a:
            if left[x] > 0:
                left[x] -= 1
            else:
                out.append(x)
        return out

    a, b = split(new), split(old)
    return excess(a, b), excess(b, a)


def digest(old: str | None, new: str | None, rendered: str | None, seconds: float, ref: str) -> str | None:
    """What changed since an earlier run: critical additions first and all of them, at most 24 lines in all otherwise.

    None unless even the whole difference is cheaper than the render.
    """
    added, gone = changed_lines(old, new)
    s = max(0, int(seconds))
    span = f"{s}s" if s < 60 else f"{s // 60}m" if s < 3600 else f"{s // 3600}h" if s < 86_400 else f"{s // 86_400}d"
    head = f"since last run ({span} ago): +{len(added)} -{len(gone)} lines [baseline: {ref}]"
    hot = [bool(_CRITICAL.search(x.strip())) for x in added]
    cands = [(0, "+" + x) for x, h in zip(added, hot) if h] + [(1, "+" + x) for x, h in zip(added, hot) if not h] + [(2, "-" + x) for x in gone]
    cost = estimate(rendered or "")
    if estimate(head + "\n") + sum(estimate(x + "\n") for _, x in cands) >= cost:
        return None
    kept, lost = fit(cands, max(DIGEST_LINES, sum(hot)), 0)
    text = "\n".join([head, *kept, *([f"... +{lost} more changes"] if lost else [])])
    return text if estimate(text) < cost else None


@F.pandas_udf(Ty.StringType())
def _digest(old: pd.Series, new: pd.Series, rendered: pd.Series, seconds: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([digest(a, b, r, s, f) for a, b, r, s, f in zip(old, new, rendered, seconds, ref)], dtype=object)


def delta_digest(pairs: DataFrame, new: str, old: str, rendered: str, seconds: str, ref: str) -> DataFrame:
    """Adds ``digest``: what changed since the baseline, if that is cheaper than the rendering; null otherwise."""
    return pairs.withColumn("digest", _digest(F.col(old), F.col(new), F.col(rendered), F.col(seconds), F.col(ref)))


def session_renders(df: DataFrame, options: EngineOptions = EngineOptions()) -> DataFrame:
    """``id, kind, shown``: renders as a session shows them: a repeat as its reference, a changed run as its difference, else whole.

    ``df``: ``id, ts, fingerprint, cwd, exit_code, profile, text`` (``scope``, ``truncated`` where known). A reference or
    difference is only taken where it is cheaper.
    """
    o, window = options, options.dedup_window_minutes * 60
    h = df.withColumn("raw_hash", dedup.content_hash(F.coalesce("text", F.lit("")))).drop("text")
    r = render(df, "text", "exit_code", "profile", o).select("id", "rendered", "exit_code", "profile", "ts")
    at = h.select(F.col("id").alias("prev_id"), F.col("ts").alias("prev_ts"), dedup.reference(F.col("raw_hash")).alias("prev_ref"))
    past = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))
    out = r.withColumns({"reference": F.lit(None).cast("string"), "digest": F.lit(None).cast("string")})
    if o.session_dedup:
        reps = dedup.exact_repeats(h, window).select("id", "prev_id").join(at, "prev_id")
        reps = out.drop("reference").join(reps, "id").withColumn("s", past / 1_000_000).withColumn("n", F.lit(2))
        reps = reference_render(reps, "rendered", "prev_ref", "s", "n", Ro.failed(F.col("exit_code"), F.col("profile"))).select("id", F.col("reference"))
        out = out.drop("reference").join(reps, "id", "left")
    if o.delta_render:
        base = dedup.delta_baselines(h, window).join(at, "prev_id")
        texts = df.select("id", F.col("text").alias("new"))
        both = base.join(texts, "id").join(texts.select(F.col("id").alias("prev_id"), F.col("new").alias("old")), "prev_id").join(r.select("id", "rendered", "ts"), "id")
        d = delta_digest(both.withColumn("s", past / 1_000_000), "new", "old", "rendered", "s", "prev_ref").select("id", "digest")
        out = out.drop("digest").join(d, "id", "left")
    kind = F.when(F.col("reference").isNotNull(), "reference").when(F.col("digest").isNotNull(), "digest").otherwise("whole")
    return out.select("id", kind.alias("kind"), F.coalesce("reference", "digest", "rendered").alias("shown"))


def with_recovery(df: DataFrame, rendered: str, omitted: Column, path: str) -> DataFrame:
    """The render with a line that says what is left out and where all of it is; unchanged where nothing is or no path is known."""
    line = F.concat(F.lit("[recovery: "), omitted.cast("string"), F.lit(" more lines; full output: "), F.col(path), F.lit("]"))
    body = F.regexp_replace(F.coalesce(F.col(rendered), F.lit("")), "\n+$", "")
    return df.withColumn(rendered, F.when((omitted > 0) & (F.coalesce(F.col(path), F.lit("")) != ""), F.concat_ws("\n", F.nullif(body, F.lit("")), line)).otherwise(F.col(rendered)))


# --- budgets from the past ----------------------------------------------------------------------------------------------

RANK = {"high": 3, "medium": 2, "low": 1}
HEAVY = {"high": 75, "medium": 50, "low": 35}  # percent that a fallback-heavy command may loosen, by confidence
DELTAS = {"lines": 2, "bytes": 64, "tokens": 12}  # smaller changes are not worth it


def adapt_budgets(runs: DataFrame, suggestions: DataFrame, tighten: int = 20, loosen: int = 25, heavy: bool = True, least: str | None = "medium", min_samples: int = 0) -> DataFrame:
    """Adds ``adapted_lines, adapted_bytes, adapted_tokens, adaptation``: budgets moved towards what the past suggests, within bounds.

    ``runs``: ``fingerprint, profile, budget_lines``. ``suggestions``: one row a fingerprint with ``profile, direction, reason,
    confidence, samples, max_lines, max_bytes, max_tokens``. A suggestion for another profile, of less confidence than ``least``
    or with a change below ``DELTAS`` is not taken. History uses the defaults; hints of a gateway 10, 15, no heavy loosening,
    no least confidence and 20 samples.
    """
    s = suggestions.select("fingerprint", F.col("profile").alias("s_profile"), "direction", "reason", "confidence", "samples", *[F.col(f"max_{k}").alias(f"s_{k}") for k in DELTAS])
    d = runs.join(s, "fingerprint", "left")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("confidence"))
    ok = (F.col("s_profile") == F.col("profile")) & (F.col("samples") >= min_samples)
    if least:
        ok &= rank >= RANK[least]
    more = F.lit(loosen)
    if heavy:
        h = F.element_at(F.create_map(*[F.lit(x) for k, v in HEAVY.items() for x in (k, max(v, loosen))]), F.col("confidence"))
        more = F.when(F.col("reason") == "fallback_heavy", h).otherwise(more)
    base = {"lines": F.col("budget_lines"), "bytes": F.col("budget_lines") * 160, "tokens": F.col("budget_lines") * 32}
    up = lambda v, pct: F.floor((v * pct + 99) / 100)
    new = {k: F.when(F.col("direction") == "tighten", F.greatest(F.col(f"s_{k}"), up(v, 100 - tighten))).otherwise(F.least(F.col(f"s_{k}"), up(v, 100 + more))) for k, v in base.items()}
    new["lines"] = F.least(F.greatest(new["lines"], F.lit(3)), F.lit(40))
    diff = {k: new[k] - base[k] for k in base}
    material, down, rise = F.lit(False), F.lit(True), F.lit(True)
    for k, x in diff.items():
        material |= F.abs(x) >= DELTAS[k]
        down &= x <= 0
        rise &= x >= 0
    ok &= material & F.when(F.col("direction") == "tighten", down).otherwise(rise)
    d = d.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    d = d.withColumns({f"adapted_{k}": F.when(F.col("__ok"), new[k]).otherwise(base[k]).cast("bigint") for k in base} | {"adaptation": F.when(F.col("__ok"), F.col("direction"))})
    return d.drop("__ok", "s_profile", "direction", "reason", "confidence", "samples", *[f"s_{k}" for k in DELTAS])
