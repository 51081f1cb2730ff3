"""What all reducers of tool output share: lines, folds, selections under a budget, failures, logs.

A reducer is a function of one captured text (``Output``) that returns the lines to show. It holds the state between the
lines of a text in plain Python; texts come and go in Arrow batches, so any number of them is one pass without shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from linelore.functions import text as T
from linelore.functions.tokens import estimate

_ANSI = re.compile(r"\x1B(?:\[[^@-~]*(?:[@-~]|$)|[\]PX^_](?:[^\x07\x1B]|\x1B(?!\\))*(?:\x07|\x1B\\|$)|[ -/]*(?:[0-~]|$))")
WIDTH = 160
CONTRACT_RAW, CONTRACT_FLOOR, CONTRACT_PART, RESERVE = 200, 48, 5, 16


def clean(text: str) -> str:
    return (_ANSI.sub("", text) if "\x1b" in text else text).replace("\r", "")


@dataclass
class Output:
    """A captured text and what may be said about it."""

    text: str
    exit_code: int = 0
    most: int = 12  # lines of the render
    profile: str = ""
    command: str = ""
    lines: list[str] = field(init=False)

    def __post_init__(self):
        self.text = clean(self.text or "")
        self.lines = [x.rstrip() for x in self.text.split("\n") if x.strip()]

    @property
    def budget(self) -> int:
        """Tokens that the contract will allow, less a reserve; 0 for texts that the contract leaves alone."""
        n = estimate(self.text.strip())
        return max(CONTRACT_FLOOR, min(-(-n // CONTRACT_PART), self.most * 32)) - RESERVE if n >= CONTRACT_RAW else 0


def clip(line: str, width: int = WIDTH) -> str:
    return line if len(line) <= width else line[:width] + "..."


def times(line: str, n: int) -> str:
    return f"{line} (x{n})" if n > 1 else line


def fold(lines: Iterable[str], key: Callable[[str], str] = lambda x: x) -> list[str]:
    """Successive lines with one key as their first one, with their number."""
    out: list[list] = []
    for x in (s.strip() for s in lines):
        if not x:
            continue
        k = key(x)
        if out and out[-1][1] == k:
            out[-1][2] += 1
        else:
            out.append([x, k, 1])
    return [times(x, n) for x, _, n in out]


def unique(lines: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(x.strip() for x in lines if x.strip()))


def more(n: int, what: str = "lines") -> list[str]:
    return [f"... +{n} more {what}"] if n > 0 else []


def limited(lines: Sequence[str], most: int, what: str = "lines") -> list[str]:
    """The first lines and how many more there are; ``ok`` for none."""
    return [clip(x) for x in lines[:most]] + more(len(lines) - most, what) if lines else ["ok"]


_CLOCK = re.compile(r"\d\d:\d\d:\d\d(?:[.,]\d+)?")
_ISO = re.compile(r"\d{4}-\d\d-.*[T_].*")
_COUNTER = re.compile(r"[0-9.,/:-]*[0-9][0-9.,/:-]*s?(?:ms)?%?")
_LEVEL = re.compile(f"(?:{T.LEVEL_TOKENS})")


def _moment(t: str) -> bool:
    t = t.strip("[]")
    return bool(_CLOCK.fullmatch(t) or re.fullmatch(r"\d{10}|\d{13}", t) or (len(t) >= 20 and _ISO.fullmatch(t)))


def _without_moment(w: list[str]) -> list[str]:
    n = 3 if len(w) >= 3 and re.fullmatch(T.MONTHS, w[0]) and re.fullmatch(r"\d{1,2}", w[1]) and _CLOCK.fullmatch(w[2]) else 1 if w and _moment(w[0]) else 0
    return w[n:] if 0 < n < len(w) else w


def similar_key(line: str) -> str:
    """The same as ``functions.text.similar_line_key``."""
    w = line.split()
    if len(w) >= 2 and _LEVEL.fullmatch(w[0].strip("[]:").upper()):
        w = [w[0], *_without_moment(w[1:])]
    else:
        w = _without_moment(w)
    if len(w) > 1 and _COUNTER.fullmatch(w[-1].strip("[({})]")):
        w = w[:-1]
    return " ".join(w)


def compact(o: Output) -> list[str]:
    return limited(fold(o.lines, similar_key), o.most)


_PLACE = re.compile(rf"(?i)\.({'|'.join(T.ANCHOR_EXTENSIONS)}):")
_RIGHT = re.compile(r"[ \t)\]}\"']")
_INLINE = re.compile(r"(?i)\[(?:eval|stdin)\]:[0-9][^ \t)\]}\"']*")


def anchor(line: str) -> str:
    """The first ``file.ext:`` reference of a line, widened to its delimiters; extensions go first in their order."""
    found = [(T.ANCHOR_EXTENSIONS.index(m[1].lower()), m.start(), m.end()) for m in _PLACE.finditer(line)]
    if found:
        _, i, j = min(found)
        start = max(line.rfind(d, 0, i) for d in " \t([{\"'") + 1
        stop = _RIGHT.search(line, j)
        return line[start : stop.start() if stop else len(line)]
    m = _INLINE.search(line)
    return m[0] if m else ""


def frames(lines: Iterable[str], most: int) -> list[str]:
    """Lines with a place, one for each place."""
    seen: dict[str, str] = {}
    for x in lines:
        a = anchor(x)
        if a:
            seen.setdefault(a.lower(), x.strip())
    return list(seen.values())[:most]


def fit(cands: Sequence[tuple[int, str]], most: int, budget: int) -> tuple[list[str], int]:
    """Lines that fit, in their order, and how many don't: tier by tier, then by position.

    A line that doesn't fit is left out and the next one is tried; tier 0 pays no heed to tokens, the first line always
    stays. 0 means no limit.
    """
    kept: list[int] = []
    left = budget
    for i in sorted(range(len(cands)), key=lambda i: (cands[i][0], i)):
        cost = estimate(cands[i][1] + "\n")
        if (most and len(kept) >= most) or (budget and kept and cands[i][0] > 0 and cost > left):
            continue
        kept.append(i)
        left -= cost
    return [cands[i][1] for i in sorted(kept)], len(cands) - len(kept)


def shown(o: Output, cands: Sequence[tuple[int, str]], what: str = "lines") -> list[str]:
    """Candidates (tier, line), unique and clipped, as many as fit."""
    best: dict[str, int] = {}
    for t, x in cands:
        x = clip(x.strip())
        if x:
            best[x] = min(t, best.get(x, t))
    kept, lost = fit([(t, x) for x, t in best.items()], o.most, o.budget)
    return kept + more(lost, what)


# --- failures -------------------------------------------------------------------------------------------------------

_RULES = [(k, re.compile(p)) for k, p in T.FAILURE_RULES]
_PASS, _FAIL, _PROGRESS, _INSTALL = (re.compile(p) for p in (T.PASSING, T.FAILING, T.PROGRESS, T.INSTALL))


def noise(line: str) -> bool:
    """Lines of passing tests, progress and installations."""
    t = line.strip().lower()
    boxed = t.startswith("[") and "/" in t and "]" in t and re.search("build|download|fetch|link", t)
    part = "%" in t and re.search("download|fetch|install|progress", t)
    return bool((_PASS.search(t) and not _FAIL.search(t)) or _PROGRESS.search(t) or boxed or part or _INSTALL.search(t))


def failure_kind(line: str) -> str:
    t = line.strip()
    for k, p in _RULES:
        if p.search(t):
            return k
    return "stack" if anchor(t) else "warning" if "warning" in t.lower() else ""


def failure(o: Output) -> list[str]:
    """Root causes, frames, hints and warnings by quotas, each once with the number of similar lines."""
    items: dict[tuple[str, str], list] = {}
    for x in o.lines:
        k = "" if noise(x) else failure_kind(x)
        if not k:
            continue
        a = anchor(x)
        key = (k, (a if a and k != "hint" else x.strip()).lower())
        if key in items:
            items[key][1] += 1
        else:
            items[key] = [x.strip(), 0]
    if not items:
        return limited(fold((x for x in o.lines if not noise(x)), similar_key), o.most)
    third = max(1, o.most // 3)
    quota = {"root": o.most // 2 + 1, "stack": third, "hint": third, "warning": o.most}
    words = {"root": "lines", "stack": "frames", "hint": "hints", "warning": "warnings"}
    cands, lost = [], 0
    for tier, k in enumerate(quota):
        mine = [v for (kk, _), v in items.items() if kk == k]
        lost += max(0, len(mine) - quota[k])
        cands += [(tier, clip(x) + (f" (+{n} similar {words[k]})" if n else "")) for x, n in mine[: quota[k]]]
    kept, left = fit(cands, o.most, o.budget)
    return kept + ([f"... omitted {lost + left} more diagnostics"] if lost + left else [])


# --- logs -----------------------------------------------------------------------------------------------------------

ORDER = ("FATAL", "ERROR", "WARN", "INFO", "DEBUG", "TRACE", "other")
_SHAPED = re.compile(r"^[\[(<]?(?i:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|ERR|FATAL|PANIC|CRITICAL|CRIT)[\])>:]?(?:\s|$)|^\s*\d{4}[-/]\d\d[-/]\d\d \d\d:\d\d:\d\d")


def log_shaped(lines: Sequence[str]) -> bool:
    """Whether most of the first forty lines (five at least) begin with a time or a level."""
    head = lines[:40]
    return len(head) >= 5 and 2 * sum(bool(_SHAPED.search(x)) or _without_moment((x + " x").split()) != (x + " x").split() for x in head) > len(head)


def severity(line: str) -> str:
    """The level among the first three words behind a line's time, or ``other``."""
    w = line.split()
    if len(w) >= 3 and re.fullmatch(r"\d{4}([-/])\d\d\1\d\d", w[0]) and _moment(w[1]):
        w = w[2:]
    else:
        w = _without_moment(w)
    for t in w[:3]:
        s = T.SEVERITIES.get(t.strip("[]()<>:,;|*").lower().rsplit("=", 1)[-1])
        if s:
            return s
    return "other"


def log_summary(o: Output) -> list[str]:
    """How many lines of each severity, every distinct error, then the most frequent other messages while lines are left."""
    seen: dict[tuple[str, str], list] = {}
    counts: Counter = Counter()
    for x in o.lines:
        s = severity(x)
        counts[s] += 1
        c = re.search(r"\d\d:\d\d:\d\d", x)
        e = seen.setdefault((s, similar_key(x)), [0, "", "", "", s])
        e[0] += 1
        e[1] = e[1] or similar_key(x)
        if c:
            e[2], e[3] = e[2] or c[0], c[0]

    def say(e: list) -> str:
        span = f" [{e[2]}..{e[3]}]" if e[0] > 1 and e[2] and e[2] != e[3] else ""
        return times(clip(e[1], 240), e[0]) + span

    head = f"{sum(counts.values()):,} lines: " + ", ".join(f"{n:,} {s}" for s, n in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])))
    bad = [say(e) for e in seen.values() if e[4] in ("FATAL", "ERROR")]
    left = max(0, o.most - 1 - len(bad))
    rest = [e for s in ORDER[2:] for e in sorted((e for e in seen.values() if e[4] == s), key=lambda e: -e[0])]
    cands = [(0, head), *((0, x) for x in bad), *((1, say(e)) for e in rest[:left])]
    kept, lost = fit(cands, 0, o.budget)
    return kept + more(lost + max(0, len(rest) - left), "distinct messages")


def by_source(o: Output, source: Callable[[str], tuple[str, str]], ordered: bool) -> list[str]:
    """Messages of each source with their number; first seen first, or by the alphabet."""
    groups: dict[str, Counter] = {}
    for x in o.lines:
        s, m = source(x)
        groups.setdefault(s, Counter())[similar_key(m)] += 1
    cands = []
    for s, ms in groups.items():
        hot = [m for m in ms if severity(m) in ("FATAL", "ERROR", "WARN") or failure_kind(m) in ("root", "stack", "warning")]
        names = (hot or list(ms)[:1]) if ordered else sorted(hot or list(ms)[:1])
        cands.append((0, f"{s}: {sum(ms.values())} lines"))
        cands += [(1 if m in hot else 2, f"{s}: {times(clip(m), ms[m])}") for m in names]
    return shown(o, cands)


def packed(parts: Sequence[str], width: int = WIDTH) -> list[str]:
    """Words joined by commas to lines of a width."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(p) + 2 <= width:
            out[-1] += ", " + p
        else:
            out.append(p)
    return out
