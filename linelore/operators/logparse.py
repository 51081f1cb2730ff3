"""Log entries from texts whose programs write different layouts.

Frequent position-word mining in two passes over the texts:

1. Every line with a moment and a level word is cut into tokens. Its *head* is the line's signs up to both of them: the
   moment with its way of writing, the level, punctuation as it is, ``w`` for other words and ``n`` for numbers. The pairs
   of position and token are counted per partition for each head and summed over the corpus.
2. A head that is frequent in the corpus and whose level word changes from line to line is a template: its level slot is
   proven to be one. (A level word that never changes is a constant of the text, as in ``info desk``, and a later slot may
   be the level.) Tokens that nearly all lines have at a place are the template's constants; the component's slot follows
   from the constants around the slots (key words before it, brackets, dashes and colons behind it).

Lines of a template are entries, with level and component at its places. Lines whose head is too rare to say (outliers)
go through fallback rules: the level word that stands as a field nearest behind the moment, the component by the usual
key words and signs. JSON lines name their fields.

A template needs SHARE of all such lines, so there are at most 1 / SHARE of them for each level word in a line,
whatever the corpus; this is what is sent to the tasks. Entries are found within each text, so no line is shuffled.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelore.session import cut_lineage

SHARE = 1e-4  # of all lines with moment and level that a template must have
MIN_SUPPORT = 20  # lines below which a head proves nothing
CONSTANT_SHARE = 0.9  # of a template's lines that have the token at its place
VARIED = 1e-3  # of a template's lines whose level isn't the most frequent one
KEPT_PAIRS = 200_000  # pairs that a task counts before it hands them on
PEEK = 96  # characters behind the moment that are read first; a line whose template isn't settled by them is read whole

# The spellings of levels.
LEVELS = {
    "trace": "TRACE", "debug": "DEBUG", "info": "INFO", "notice": "INFO", "warn": "WARN", "warning": "WARN", "error": "ERROR", "err": "ERROR",
    "severe": "ERROR", "fatal": "FATAL", "crit": "FATAL", "critical": "FATAL", "emerg": "FATAL",
}
LETTERS = {"T": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL"}
NUMBERS = {"10": "TRACE", "20": "DEBUG", "30": "INFO", "40": "WARN", "50": "ERROR", "60": "FATAL"}
MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
LEVEL_KEYS = {"level", "lvl", "severity", "levelname", "loglevel"}
TIME_KEYS = {"time", "ts", "timestamp", "@timestamp", "t", "at", "date"}
COMPONENT_KEYS = {"component", "logger", "name", "module", "subsystem", "caller", "source"}
STOP_WORDS = {"in", "at", "by", "from", "of", "pid", "tid", "thread", "host", "msg", "message"}

_MON = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_CLOCK = r"(?P<{0}h>\d\d):(?P<{0}m>\d\d):(?P<{0}s>\d\d)(?:[.,](?P<{0}f>\d{{1,9}}))?"
MOMENT = re.compile(
    r"(?:"
    r"(?P<iy>\d{4})[-/](?P<imo>\d\d)[-/](?P<id>\d\d)[T ]" + _CLOCK.format("i") + r"(?: ?(?P<iz>Z|UTC|GMT|[+-]\d\d:?\d\d)\b)?"
    rf"|(?P<cd>\d\d)/(?P<cmo>{_MON})/(?P<cy>\d{{4}}):" + _CLOCK.format("c") + r"(?: (?P<cz>[+-]\d\d:?\d\d))?"
    rf"|(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) )?(?P<smo>{_MON}) +(?P<sd>\d\d?) " + _CLOCK.format("s") + r"(?: (?P<sy>\d{4})\b)?"
    r"|(?P<gmo>[01]\d)(?P<gd>[0-3]\d) " + _CLOCK.format("g")
    + r"|(?<![\d.:-])" + _CLOCK.format("t") + r"(?![\d:])"
    r"|(?<![\w.:-])(?P<es>1\d{9})(?:\.(?P<ef>\d{1,9}))?(?![\w.:])"
    r"|(?<![\w.:-])(?P<em>1\d{12})(?![\w.:])"
    r")"
)
TOKEN = re.compile(r"[A-Za-z@][\w.@-]*\w|[A-Za-z@]|\d[\w.-]*|[^\sA-Za-z0-9\",]")
EPOCH = datetime(1970, 1, 1)
DAY_US = 86_400_000_000


@functools.lru_cache(maxsize=4096)
def _day(year: int, month: int, day: int) -> int | None:
    """Days since 1970, None for an impossible date."""
    try:
        return date(year, month, day).toordinal() - 719_163
    except ValueError:
        return None


@functools.lru_cache(maxsize=256)
def _zone_us(z: str | None) -> int:
    if not z or z in ("Z", "UTC", "GMT"):
        return 0
    z = z.replace(":", "")
    return (-1 if z[0] == "-" else 1) * (int(z[1:3]) * 60 + int(z[3:5])) * 60_000_000


def moment_ms(m: re.Match, until: int | None) -> int | None:
    """Milliseconds since 1970 of a moment; what its date lacks makes it the latest one not after ``until`` (microseconds).

    Null for an impossible date, and for a moment without full date where ``until`` is null.
    """
    if m["es"]:
        return int(m["es"]) * 1000 + int((m["ef"] or "0").ljust(3, "0")[:3])
    if m["em"]:
        return int(m["em"])
    p = next(p for p in "icsgt" if m[p + "h"])
    h, mi, s = int(m[p + "h"]), int(m[p + "m"]), int(m[p + "s"])
    if h > 23 or mi > 59 or s > 59:
        return None
    clock = ((h * 60 + mi) * 60 + s) * 1_000_000 + int((m[p + "f"] or "0").ljust(6, "0")[:6])
    if p == "i" or p == "c" or (p == "s" and m["sy"]):
        month = m[p + "mo"]
        day = _day(int(m[p + "y"]), MONTHS.get(month) or int(month), int(m[p + "d"]))
        return None if day is None else (day * DAY_US + clock - (_zone_us(m[p + "z"]) if p != "s" else 0)) // 1000
    if until is None:
        return None
    today = until // DAY_US
    if p == "t":
        day = today if today * DAY_US + clock <= until else today - 1
        return (day * DAY_US + clock) // 1000
    month = MONTHS.get(m[p + "mo"]) or int(m[p + "mo"])
    year = (EPOCH + timedelta(days=today)).year
    for y in range(year, year - 9, -1):  # 29 February may be eight years away
        day = _day(y, month, int(m[p + "d"]))
        if day is not None and day * DAY_US + clock <= until:
            return (day * DAY_US + clock) // 1000
    return None


def head_kind(m: re.Match) -> str:
    """The sign of a moment by its way of writing."""
    return "<T" + ("e" if m["es"] or m["em"] else next(p for p in "icsgt" if m[p + "h"])) + ">"


class _Signs(dict):
    """The sign of a token wherever it stands."""

    def __missing__(self, t: str) -> str:
        if len(self) > 100_000:
            self.clear()
        c = t[0]
        s = ("L" if t.lower() in LEVELS else "w") if c.isalpha() or c == "@" else "n" if c.isdigit() else t
        self[t] = s
        return s


_SIGNS = _Signs()


def tokens(line: str, m: re.Match, stop: int | None = None) -> tuple[list[str], list[str], int]:
    """The tokens of a line (up to ``stop``) with its moment, their signs, and the moment's place; levels have the sign ``L``."""
    toks = TOKEN.findall(line, 0, m.start())
    at = len(toks)
    toks.append("<T>")
    toks += TOKEN.findall(line, m.end(), len(line) if stop is None else stop)
    signs = [_SIGNS[t] for t in toks]
    signs[at] = head_kind(m)
    if at == 1 and toks[0] in LETTERS:
        signs[0] = "L"
    elif "n" in signs:
        for i, t in enumerate(toks):
            if signs[i] == "n" and t in NUMBERS and i > 1 and toks[i - 1] in "=:" and toks[i - 2].lower() in LEVEL_KEYS:
                signs[i] = "L"
    return toks, signs, at


def fallback_level(toks: list[str], signs: list[str], at: int) -> int:
    """The place of an outlier's level, -1 for none: behind a level key, or the first level word behind the moment (else the last
    before it) that is written large, stands in signs of its own, or has no more than two words (host, component) before it."""
    places = [i for i, s in enumerate(signs) if s == "L"]
    for i in places:
        if i > 1 and toks[i - 1] in "=:" and toks[i - 2].lower() in LEVEL_KEYS:
            return i
    fenced = lambda i: i > 0 and toks[i - 1] in "[(<-|/:=" and i + 1 < len(toks) and toks[i + 1] in "])>-|/:="
    stated = [i for i in places if toks[i].isupper() or fenced(i) or (i > at and sum(s in "wn" for s in signs[at + 1 : i]) <= 2)]
    return next((i for i in stated if i > at), stated[-1] if stated else -1)


HOST = re.compile(r"^[A-Za-z][A-Za-z0-9]*-\d+$")
EXTENSION = re.compile(r"\.(?:go|py|rs|js|ts|java|kt|c|cc|cpp|rb|php|cs|scala|swift)$")


def component_at(toks: list[str], skel: list[str], at: int, level: int, constant: set[int]) -> int | None:
    """The place of the component's word by the template's structure, or None."""
    words = [i for i, s in enumerate(skel) if s == "w"]
    for i in words:  # a key says it
        if toks[i].lower() in COMPONENT_KEYS and i + 1 < len(toks):
            j = i + 1
            while j < len(toks) and toks[j] in "=:":
                j += 1
            if j > i + 1 and j < len(skel) and skel[j] == "w":
                return j
    # a word that never changes may be a component too, where a program has only one: then its signs must set it off
    fenced = lambda i: (toks[i - 1] in "[(<-" or skel[i - 1] == "n") and i + 1 < len(toks) and toks[i + 1] in "])>:-/"
    named = [i for i in words if toks[i].lower() not in STOP_WORDS]
    between = [i for i in named if min(at, level) < i < max(at, level)]
    if between:  # the last one before the level; a host stands before it
        between = [i for i in between if not HOST.match(toks[i])] or between
        return ([i for i in between if i not in constant] or between)[-1]
    after = [i for i in named if i > max(at, level) and (i not in constant or fenced(i) or skel[i - 1] == "w")]
    return after[0] if after else None


def _json_entry(line: str) -> tuple[str, str, re.Match] | None:
    """Level, component and moment of a line that is one JSON object and states the first and the last; else None."""
    try:
        o = json.loads(line)
    except (ValueError, RecursionError):
        return None
    if not isinstance(o, dict):
        return None
    low = {str(k).lower(): v for k, v in o.items()}
    level = next((low[k] for k in low if k in LEVEL_KEYS), None)
    m = MOMENT.fullmatch(str(next((low[k] for k in low if k in TIME_KEYS), "")))
    name = next((low[k] for k in low if k in COMPONENT_KEYS), None)
    return None if level is None or m is None else (str(level), "" if name is None else str(name), m)


class Templates:
    """The mined templates (head to its constants by place), and the component's place of each once it was seen."""

    def __init__(self, mined: dict[str, dict[int, str]]):
        self.mined = mined
        self.component: dict[str, int | None] = {}

    def place_of_component(self, head: str, toks: list[str], signs: list[str], at: int, level: int) -> int | None:
        """By the template where a slot of it says so, else (None or beyond its last constant) by the line."""
        if head in self.component and (i := self.component[head]) is not None:
            return i if i < len(signs) and signs[i] == "w" else component_at(toks, signs, at, level, set())
        constants = self.mined.get(head)
        if constants is None:
            return component_at(toks, signs, at, level, set())
        same = {i for i, t in constants.items() if i < len(toks) and toks[i] == t and signs[i] == "w"}
        i = component_at(toks, signs, at, level, same)
        if head not in self.component and i is not None and i <= max(at, level, *constants):
            self.component[head] = i
        return i

    def template(self, signs: list[str], at: int) -> tuple[int, str]:
        """The level's place and the template of a line; -1 for an outlier."""
        i = -1
        for _ in range(signs.count("L")):
            i = signs.index("L", i + 1)
            head = " ".join(signs[: max(at, i) + 1])
            if head in self.mined:
                return i, head
        return -1, ""

    def entry(self, line: str, until: int | None) -> tuple[int, str, str, int] | None:
        """ts_ms, level, component and the message's offset for a line that begins an entry, else None."""
        if line[:1] == "{" and line[-1] == "}":  # fields have names here, in any order
            j = _json_entry(line)
            if j is None:
                return None
            word, comp, m = j
            start = 0
        else:
            m = MOMENT.search(line)
            if m is None:
                return None
            stop = m.end() + PEEK
            toks, signs, at = tokens(line, m, stop)
            level, head = self.template(signs, at)
            known = self.component.get(head)
            if stop < len(line) and (level < 0 or known is None or max(level, known) + 2 >= len(toks)):  # the rest may count
                toks, signs, at = tokens(line, m)
                level, head = self.template(signs, at)
            if level < 0:  # an outlier
                level = fallback_level(toks, signs, at)
                if level < 0:
                    return None
            word, start = toks[level], m.end()
            i = self.place_of_component(head, toks, signs, at, level)
            comp = toks[i] if i is not None else ""
            if i is not None and i + 1 < len(toks) and toks[i + 1] == ":" and EXTENSION.search(comp):
                comp = EXTENSION.sub("", comp)
        name = LEVELS.get(word.lower()) or LETTERS.get(word) or NUMBERS.get(word)
        ts = moment_ms(m, until)
        return None if name is None or ts is None else (ts, name, comp, start)


# What a line must hold to be looked at: for whole columns at once, by an engine that knows no context.
_RE2_ANSI = r"\x1b(?:\[[0-?]*[ -/]*[@-~]|[\]PX^_][^\x07\x1b]*(?:\x07|\x1b\\)|[ -/]*[0-~])"
_RE2_LABEL = r"^[A-Za-z][\w.-]*-[0-9]+ +\| ?"
_RE2_MOMENT = r"[0-9]{2}:[0-9]{2}:[0-9]{2}|1[0-9]{9}"
_RE2_LEVEL = r"(?i)trace|debug|info|notice|warn|err|severe|fatal|crit|emerg|level|lvl|severity|^[TDIWEF][01][0-9][0-3][0-9] "


def clean_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of many texts without colour codes, line ends and labels of streams, and the place at which each text begins."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat = parts.flatten()
    if pc.any(pc.match_substring(flat, "\x1b")).as_py():
        flat = pc.replace_substring_regex(flat, _RE2_ANSI, "")
    flat = pc.replace_substring_regex(flat, _RE2_LABEL, "")
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    return pc.utf8_rtrim_whitespace(flat), np.concatenate([[0], np.cumsum(sizes)])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    levels: Counter = Counter()  # of (head, level word)
    places: dict[str, list[dict[str, int]]] = {}  # of a head, the tokens at each place
    schema = pa.schema([("head", pa.string()), ("place", pa.int32()), ("token", pa.string()), ("n", pa.int64())])

    def out() -> pa.RecordBatch:
        rows = [(h, -1, t, n) for (h, t), n in levels.items()] + [(h, j, t, n) for h, ps in places.items() for j, p in enumerate(ps) for t, n in p.items()]
        levels.clear()
        places.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for b in batches:
        for k in range(0, b.num_rows, 256):
            flat, _ = clean_lines(b.column(0).slice(k, 256))
            looks = pc.and_(pc.match_substring_regex(flat, _RE2_MOMENT), pc.match_substring_regex(flat, _RE2_LEVEL))
            for line in flat.filter(looks).to_pylist():
                if line[0] == "{" and line[-1] == "}":
                    continue
                m = MOMENT.search(line)
                if m is None:
                    continue
                toks, signs, at = tokens(line, m)
                n = signs.count("L")
                if not n:
                    continue
                levels["", ""] += 1
                i = -1
                for _ in range(n):
                    i = signs.index("L", i + 1)
                    head = " ".join(signs[: max(at, i) + 1])
                    levels[head, toks[i].lower()] += 1
                    ps = places.setdefault(head, [])
                    while len(ps) < len(toks):
                        ps.append({})
                    for p, t in zip(ps, toks):
                        p[t] = p.get(t, 0) + 1
            if sum(len(p) for ps in places.values() for p in ps) > KEPT_PAIRS:
                yield out()
    if levels:
        yield out()


def mine_templates(texts: DataFrame, text: str = "text") -> DataFrame:
    """``head, place, token``: the constants of the corpus' templates; place -1 stands for the template itself."""
    pairs = texts.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_mine, "head string, place int, token string, n bigint")
    pairs = cut_lineage(pairs.groupBy("head", "place", "token").agg(F.sum("n").alias("n")))  # read twice below
    seen = pairs.where("place = -1").groupBy("head").agg(F.sum("n").alias("lines"), F.max("n").alias("most"))
    every = seen.where("head = ''").agg(F.sum("lines")).first()[0] or 0
    support, varied = max(float(MIN_SUPPORT), SHARE * every), F.greatest(F.lit(2.0), F.lit(VARIED) * F.col("lines"))
    frequent = seen.where("head <> ''").where((F.col("lines") >= support) & (F.col("lines") - F.col("most") >= varied)).select("head", "lines")
    constant = pairs.where("place >= 0 and token <> '<T>'").join(F.broadcast(frequent), "head").where(F.col("n") >= F.lit(CONSTANT_SHARE) * F.col("lines"))
    return constant.select("head", "place", "token").unionByName(frequent.select("head", F.lit(-1).alias("place"), F.lit("").alias("token")))


ENTRY_SCHEMA = "record_id bigint, first_line bigint, last_line bigint, ts_ms bigint, level string, component string, message string"
_ARROW = pa.schema([("record_id", pa.int64()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("ts_ms", pa.int64()), ("level", pa.string()), ("component", pa.string()), ("message", pa.string())])


def _assign(mined: dict[str, dict[int, str]], with_message: bool):
    def some(t: Templates, b: pa.RecordBatch) -> pa.RecordBatch | None:
        flat, starts = clean_lines(b.column(1))
        untils = b.column(2).to_pylist()
        at = np.flatnonzero(pc.match_substring_regex(flat, _RE2_MOMENT).to_numpy(zero_copy_only=False))
        owner = np.searchsorted(starts, at, "right") - 1
        found, rows = [], []
        for i, d, line in zip(at.tolist(), owner.tolist(), flat.take(pa.array(at)).to_pylist()):
            e = t.entry(line, untils[d])
            if e is not None:
                found.append(i)
                rows.append((d, *e))
        if not found:
            return None
        first = np.array(found)
        d = np.array([r[0] for r in rows])
        stop = np.minimum(np.append(first[1:], len(flat)), starts[d + 1])
        full = pc.greater(pc.utf8_length(pc.utf8_ltrim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
        last = np.maximum.accumulate(np.where(full, np.arange(len(flat)), -1))[stop - 1]
        text = pa.nulls(len(first), pa.string())
        if with_message:
            ls = flat.to_pylist()
            text = pa.array(["\n".join([ls[i][r[4] :].strip(), *ls[i + 1 : j + 1]]).rstrip() for i, j, r in zip(found, last.tolist(), rows)], pa.string())
        cols = [b.column(0).take(pa.array(d)), pa.array(first - starts[d] + 1), pa.array(last - starts[d] + 1), *(pa.array([r[k] for r in rows], _ARROW.field(k + 2).type) for k in (1, 2, 3)), text]
        return pa.record_batch(cols, schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(mined)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                out = some(t, b.slice(k, 256))
                if out is not None:
                    yield out

    return run


def parse_entries(df: DataFrame, record_id: str, text: str, until: str, with_message: bool = True) -> DataFrame:
    """``record_id, first_line, last_line, ts_ms, level, component, message``: one row per log entry of each text.

    An entry begins on a line that states its time and its level and ends with the last line that isn't blank before the
    next entry or the end. Null and empty texts and texts without entries give nothing; a time whose date is incomplete
    is the latest one not after ``until`` (with a null ``until`` such a line begins no entry). Equal rows give equal
    entries. An entry without component has an empty one.
    """
    mined: dict[str, dict[int, str]] = {}
    for r in mine_templates(df, text).collect():  # bounded by SHARE
        mined.setdefault(r.head, {}).update({r.place: r.token} if r.place >= 0 else {})
    src = df.select(F.col(f"`{record_id}`").cast("bigint"), F.col(f"`{text}`").cast("string"), F.unix_micros(F.col(f"`{until}`").cast("timestamp")))
    return src.mapInArrow(_assign(mined, with_message), ENTRY_SCHEMA)


def stamp_ms(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Adds ``ts_ms``: a written moment with full date and time, or an epoch time in s or ms; null for anything else.

    Without a zone it is UTC; fractions beyond milliseconds are cut off.
    """
    s = F.trim(F.col(f"`{column}`").cast("string"))
    parts = r"^(\d{4})[-/](\d\d)[-/](\d\d)[T ](\d\d:\d\d:\d\d)(?:[.,](\d{1,9}))? ?(Z|UTC|GMT|[+-]\d\d:?\d\d)?$"
    g = lambda i: F.regexp_extract(s, parts, i)
    zone = F.when(g(6).isin("", "Z", "UTC", "GMT"), F.lit("+00:00")).otherwise(F.regexp_replace(g(6), r"^([+-]\d\d):?(\d\d)$", "$1:$2"))
    whole = F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit(" "), g(4), zone).try_cast("timestamp")
    written = F.unix_seconds(whole) * 1000 + F.rpad(F.substring(g(5), 1, 3), 3, "0").try_cast("bigint")
    epoch = F.when(s.rlike(r"^\d{10}$"), s.try_cast("bigint") * 1000).when(s.rlike(r"^\d{10}\.\d{1,9}$"), F.floor(s.try_cast("decimal(20,9)") * 1000)).when(s.rlike(r"^\d{13}$"), s.try_cast("bigint"))
    return df.withColumn("ts_ms", F.when(s.rlike(parts), written).otherwise(epoch).cast("bigint"))


def found_entries(captures: DataFrame, usage_lines: DataFrame) -> DataFrame:
    """The entries of captures and the moments of usage lines in one table, without messages."""
    e = parse_entries(captures, "capture_id", "raw_combined", "captured_at", with_message=False)
    e = e.select(F.lit("captures").alias("record_table"), "record_id", "first_line", "last_line", "ts_ms", "level", "component")
    u = stamp_ms(usage_lines.select(F.col("line_id").alias("record_id"), "timestamp")).where("ts_ms is not null")
    one = F.lit(1).cast("bigint")
    u = u.select(F.lit("usage_lines").alias("record_table"), "record_id", one.alias("first_line"), one.alias("last_line"), "ts_ms", F.lit("").alias("level"), F.lit("").alias("component"))
    return e.unionByName(u)
