"""Reducers of texts line by line, and the declarative specs that describe them.

A text stays in its row: its lines are an array, and folding, filtering and cutting are array functions, so no line is
shuffled and texts of any number are reduced in one pass.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelore.functions import text as T


@dataclass(frozen=True)
class Spec:
    """A line pipeline as data; stages run in the order drop_empty, keep/strip, fold, clip, head/tail."""

    name: str
    description: str = ""
    keep_patterns: Sequence[str] = ()
    strip_patterns: Sequence[str] = ()
    head: int = 0
    tail: int = 0
    max_line_width: int = 0
    drop_empty: bool = False
    dedup_consecutive: bool = False
    fold_similar: bool = False
    empty_message: str = ""

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", self.name or ""):
            raise ValueError(f"spec name {self.name!r}")
        if min(self.head, self.tail, self.max_line_width) < 0:
            raise ValueError(f"{self.name}: negative limit")
        for p in (*self.keep_patterns, *self.strip_patterns):
            re.compile(p)

    @classmethod
    def from_dict(cls, d: dict) -> Spec:
        unknown = set(d) - {f.name for f in fields(cls)} - {"match"}
        if unknown:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k != "match"})

    def limited(self, limit: int) -> Spec:
        """With a total limit of lines instead of its own, in the same shape."""
        if limit <= 0:
            return self
        head, tail = self.head, self.tail
        if tail > 0 and head == 0:
            tail = limit
        elif tail > 0:
            head, tail = (1, limit - 1) if tail >= limit else (limit - tail, tail)
        else:
            head = limit
        return Spec(**{**self.__dict__, "head": head, "tail": tail})


INTERESTING = ("error", "warn", "fail", "fatal", "panic", "exception", "traceback", "timeout", "refused", "denied")
BUILTIN = {
    s.name: s
    for s in (
        Spec("compact_lines", drop_empty=True, dedup_consecutive=True, fold_similar=True, head=12),
        Spec("interesting_error_lines", keep_patterns=tuple(f"(?i){w}" for w in INTERESTING), drop_empty=True, head=12, max_line_width=160, empty_message="ok"),
        Spec("read_minimal", strip_patterns=(r"^\s*//", r"^\s*#"), head=40),
    )
}


def load_specs(folder: str) -> tuple[dict[str, Spec], list[str]]:
    """The builtin specs and those of a folder's JSON files in the order of their names; unreadable ones become warnings."""
    out, warnings = dict(BUILTIN), []
    for p in sorted(Path(folder).glob("*.json")):
        try:
            s = Spec.from_dict(json.loads(p.read_text()))
            out[s.name] = s
        except (ValueError, TypeError, re.error) as e:
            warnings.append(f"{p.name}: {e}")
    return out, warnings


def spec_lines(text: Column) -> Column:
    """All lines; both line ends count, an empty last line doesn't."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def reducer_lines(text: Column) -> Column:
    """The lines that aren't empty, without trailing white space and colour codes."""
    return F.filter(F.transform(F.split(F.regexp_replace(T.strip_ansi(text), "\r", ""), "\n"), T.rtrim), lambda x: x != "")


def fold(df: DataFrame, lines: str, out: str, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Runs of lines with equal keys as ``line (xN)``; blank lines are dropped and don't divide."""
    es = F.transform(F.filter(F.transform(F.col(lines), T.trim), lambda x: x != ""), lambda x: F.struct(x.alias("line"), (key(x) if key else x).alias("key")))
    df = df.withColumn("__es", es)
    n = F.size("__es")
    at = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("__es", i)["key"] != F.get("__es", i - 1)["key"]))).when(n == 0, F.array().cast("array<int>"))
    df = df.withColumn("__at", at)
    size = lambda s, j: F.coalesce(F.get("__at", j + 1), F.size("__es")) - s
    line = lambda s, j: F.concat(F.get("__es", s)["line"], F.when(size(s, j) > 1, F.concat(F.lit(" (x"), size(s, j).cast("string"), F.lit(")"))).otherwise(""))
    return df.withColumn(out, F.transform("__at", line)).drop("__es", "__at")


def apply_spec(df: DataFrame, spec: Spec, text: str = "text") -> DataFrame:
    """Adds ``rendered``, ``total_lines`` and ``omitted`` (of the folded view) for each text; a null text renders as null."""
    keep = ls = spec_lines(F.col(text))
    if spec.drop_empty:
        keep = F.filter(keep, lambda x: T.trim(x) != "")
    if spec.keep_patterns:
        keep = F.filter(keep, lambda x: x.rlike("|".join(f"(?:{p})" for p in spec.keep_patterns)))
    if spec.strip_patterns:
        keep = F.filter(keep, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in spec.strip_patterns)))
    df = df.withColumn("__ls", keep if keep is not ls else ls)
    if spec.fold_similar:
        df = fold(df, "__ls", "__ls", T.similar_line_key)
    elif spec.dedup_consecutive:
        df = fold(df, "__ls", "__ls")
    if spec.max_line_width:
        df = df.withColumn("__ls", F.transform("__ls", lambda x: T.clip(x, spec.max_line_width)))
    n, ls = F.size("__ls"), F.col("__ls")
    h, t = spec.head, spec.tail
    more = lambda k, what: F.array(F.concat(F.lit("... +"), k.cast("string"), F.lit(f" {what} lines")))
    if h and t:
        cut, omitted = F.concat(F.slice(ls, 1, h), more(n - h - t, "more"), F.slice(ls, -t, t)), n - h - t
    elif t:
        cut, omitted = F.concat(more(n - t, "earlier"), F.slice(ls, -t, t)), n - t
    elif h:
        cut, omitted = F.concat(F.slice(ls, 1, h), more(n - h, "more")), n - h
    else:
        cut, omitted = ls, F.lit(0)
    over = omitted > 0
    shown = F.array_join(F.when(over, cut).otherwise(ls), "\n")
    return df.withColumns({"rendered": F.when(n == 0, F.lit(spec.empty_message)).otherwise(shown), "total_lines": F.when(n >= 0, n), "omitted": F.when(ls.isNotNull(), F.greatest(omitted, F.lit(0)))}).drop("__ls")


def explode_lines(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id, line_no, line``: every line of each text as a row, from 1."""
    return df.select(F.col(record_id).alias("record_id"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select("record_id", (F.col("pos") + 1).alias("line_no"), "line")


def unique_lines(lines: Column) -> Column:
    """Trimmed lines in order of their first occurrence."""
    return F.array_distinct(F.filter(F.transform(lines, T.trim), lambda x: x != ""))


def join_limited(lines: Column, most: int) -> Column:
    """The first lines and how many more there are; ``ok`` for none."""
    n = F.size(lines)
    over = F.concat_ws("\n", F.slice(lines, 1, most), F.concat(F.lit("... +"), (n - most).cast("string"), F.lit(" more lines")))
    return F.when(n == 0, "ok").when(n <= most, F.array_join(lines, "\n")).otherwise(over)
