"""Reducers of the output of particular tools.

Tools whose output is prose with failures in it are described by ``Rules`` (tiers of patterns, detail lines behind a
header, a sentence for success); tools whose output is a list of things have a function that reads and counts them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from linelore.operators.search import NOISE_DIRS
from linelore.reducers import structured as S
from linelore.reducers.base import Output, anchor, by_source, clip, compact, failure, fit, fold, frames, limited, log_shaped, log_summary, more, shown, times, unique


def count(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


@dataclass(frozen=True)
class Rules:
    """(tier, pattern) in order, the first match counts; ``detail`` lines behind a match of ``header`` have tier 2 until one
    matches ``stop``; ``frames`` says how many further lines with a place are kept; ``done`` gives the sentence of a success."""

    tiers: Sequence[tuple[int, str]]
    header: str = ""
    detail: int = 0
    stop: str = r"^\s*at "
    frames: int = 0
    done: Callable[[Output], list[str] | None] | None = None

    def __call__(self, o: Output) -> list[str]:
        if self.done and o.exit_code == 0:
            said = self.done(o)
            if said:
                return limited(said, o.most)
        cands: list[tuple[int, str]] = []
        left, blank = 0, False
        rules = [(t, re.compile(p)) for t, p in self.tiers]
        header, stop = (re.compile(p) if p else None for p in (self.header, self.stop))
        for x in o.text.split("\n"):
            if not x.strip():
                left = 0
                continue
            tier = next((t for t, p in rules if p.search(x)), None)
            if tier is None and left and not (stop and stop.search(x)):
                tier, left = 2, left - 1
            if tier is not None:
                cands.append((tier, x))
            if header is not None and header.search(x):
                left = self.detail
        if self.frames:
            have = {x.strip() for _, x in cands}
            cands += [(3, x) for x in frames(o.lines, self.frames) if x not in have]
        if not cands:
            return failure(o) if o.exit_code else compact(o)
        folded: list[tuple[int, str]] = []
        for t, x in cands:
            if folded and folded[-1][1].strip() == x.strip():
                continue
            folded.append((t, x))
        return shown(o, folded)


def folder(path: str) -> str:
    """``dir/`` of a path, ``./`` for a path of one part."""
    d, _, _ = path.rpartition("/")
    return d + "/" if d or path.startswith("/") else "./"


def extension(path: str) -> str:
    _, dot, ext = path.rpartition("/")[2].rpartition(".")
    return (dot + ext).lower() if dot else "[no-ext]"


def last(o: Output, pattern: str) -> str | None:
    found = [x.strip() for x in o.lines if re.search(pattern, x)]
    return found[-1] if found else None


# --- version control --------------------------------------------------------------------------------------------------


def git_status(o: Output) -> list[str]:
    """Branch, and how many entries are staged, changed and untracked; one or two entries as they are."""
    branch = next((x[3:] for x in o.lines if x.startswith("## ")), None)
    entries = [x for x in o.text.split("\n") if re.match(r"^(?:[MADRCUT ][MADRCUT ]|\?\?|!!) \S", x)]
    if branch is None and not entries:
        m = re.search(r"On branch (\S+)", o.text)
        branch, part = m[1] if m else None, ""
        for x in o.lines:
            if re.match(r"^(?:Changes to be committed|Changes not staged|Untracked files|Unmerged paths)", x):
                part = {"Changes to": "M ", "Changes no": " M", "Untracked ": "??", "Unmerged p": "UU"}[x[:10]]
            elif part and re.match(r"^(?:\t| {2,})[^(\s]", x):
                entries.append(f"{part} {re.sub(r'^(?:modified|new file|deleted|renamed|both modified): +', '', x.strip())}")
        if branch is None and not entries:
            return compact(o)
    out = [f"branch: {branch}"] if branch else []
    if not entries:
        return [*out, "clean"]
    staged = sum(x[0] in "MADRCUT" for x in entries)
    changed = sum(x[1] in "MADRCUT" for x in entries)
    out.append(f"staged={staged} unstaged={changed} untracked={sum(x[:2] == '??' for x in entries)}")
    if len(entries) <= 2:
        return out + entries
    dirs = Counter(folder(x[3:]) for x in entries)
    return limited(out + [f"{d} {n}" for d, n in dirs.most_common()], o.most)


def git_log(o: Output) -> list[str]:
    """Number of commits and their subjects, equal ones in a row folded."""
    cs: list[list[str]] = []
    for x in o.lines:
        m = re.match(r"^commit ([0-9a-f]{7,40})", x) or re.match(r"^[*|/\\ ]*([0-9a-f]{7,40}) (?:\([^)]*\) )?(\S.*)$", x)
        if m:
            cs.append([m[1][:8], m[2] if m.re.groups > 1 else ""])
        elif cs and not cs[-1][1] and x.startswith("    "):
            cs[-1][1] = x.strip()
    if not cs:
        return compact(o)
    rows: list[list] = []
    for h, s in cs:
        if rows and rows[-1][1] == s:
            rows[-1][2] += 1
        else:
            rows.append([h, s, 1])
    kept, lost = fit([(0, count(len(cs), "commit")), *((1, clip(times(f"{h} {s}", n))) for h, s, n in rows)], o.most, o.budget)
    return kept + more(lost, "commits")


def diff_files(lines: Sequence[str]) -> list[dict]:
    """The files of a unified diff with their hunks and changed lines."""
    out: list[dict] = []
    for x in lines:
        m = re.match(r"^diff --git a/(.+?) b/(.+)$", x) or (re.match(r"^\+\+\+ (?:b/)?(\S+)()", x) if not out or out[-1]["hunks"] or out[-1]["plain"] else None)
        if m:
            out.append({"path": m[2] or m[1], "hunks": 0, "add": 0, "del": 0, "body": [], "flags": [], "plain": x.startswith("+++")})
        elif out and x.startswith("@@"):
            out[-1]["hunks"] += 1
            out[-1]["body"].append(x)
        elif out and re.match(r"^(?:new file|deleted file|rename (?:from|to)|Binary files|similarity)", x):
            out[-1]["flags"].append(x.split(" mode")[0])
        elif out and out[-1]["hunks"] and x[:1] in "+-" and not x.startswith(("+++", "---")):
            out[-1]["add" if x[0] == "+" else "del"] += 1
            out[-1]["body"].append(x)
    return out


def git_diff(o: Output) -> list[str]:
    """``files=F +A -D``; small diffs with their changed lines, large ones by the files that change most."""
    if not any(x.startswith(("diff --git", "+++ ")) for x in o.lines):
        stat = [x for x in o.lines if re.search(r"\| +\d+|\| Bin|files? changed", x)]
        if stat:
            total = [x.strip() for x in stat if "changed" in x]
            churn = sorted((x for x in stat if "|" in x), key=lambda x: -int((re.search(r"\| +(\d+)", x) or [0, 0])[1]))
            return limited(total + [re.sub(r"\s+\|\s+(\d+).*", r" \1", x.strip()) for x in churn], o.most, "files")
        return compact(o)
    fs = diff_files(o.lines)
    head = [x for x in o.lines[: next(i for i, x in enumerate(o.lines) if x.startswith(("diff --git", "+++ ")))] if not x.startswith(("Author", "index"))][:3]
    out = [*head, f"files={len(fs)} +{sum(f['add'] for f in fs)} -{sum(f['del'] for f in fs)}"]
    say = lambda f: f"{f['path']} hunks={f['hunks']} +{f['add']} -{f['del']}" + "".join(f" [{x}]" for x in f["flags"][:1])
    whole = [(0, x) for x in out] + [c for f in fs for c in [(0, say(f)), *((1, clip(x)) for x in f["body"])]]
    kept, lost = fit(whole, o.most, o.budget)
    if not lost:
        return kept
    most = max(1, o.most - len(out) - 1)
    top = sorted(fs, key=lambda f: (-f["add"] - f["del"], f["path"]))
    names, rest = top[:most], top[most:]
    dirs = Counter(folder(f["path"]) for f in rest)
    return out + [clip(say(f)) for f in names] + ([f"... +{len(rest)} more files in " + ", ".join(f"{d} ({n})" for d, n in dirs.most_common(4))] if rest else [])


_MUST = r"^CONFLICT|^error: |^fatal: |! \[(?:remote )?rejected\]|^Automatic merge failed"
_REF = re.compile(r"^\s*(?:[*+=t!-] )?\s*(?:\[[^\]]*\]|[0-9a-f]{6,}\.{2,3}[0-9a-f]{6,})\s+(\S+)\s+-> \s*(\S+)")


def git_transfer(o: Output) -> list[str]:
    """Conflicts, errors and hints, results, refs with their number, the objects' total."""
    must, hints, refs, other = [], [], [], []
    auto, total = 0, None
    for x in o.lines:
        t = x.strip()
        m = re.match(r"^(?:remote: )?(?:Receiving|Total|Resolving deltas).*?(\d+)(?:/\d+)?\)?", t)
        if re.search(_MUST, t):
            must.append(t)
        elif t.startswith("hint:"):
            hints.append(t)
        elif t.startswith("Auto-merging"):
            auto += 1
        elif re.match(r"^(?:remote: )?Total \d+", t) or "Receiving objects: 100%" in t or "Writing objects: 100%" in t:
            total = t
        elif _REF.match(x):
            refs.append(re.sub(r"\s+", " ", t))
        elif not m and not re.match(r"^(?:remote: )?(?:Enumerating|Counting|Compressing|Receiving|Resolving|Writing|Unpacking|Updating files|Delta)", t):
            other.append(t)
    sums = ([times("Auto-merging files", auto)] if auto else []) + ([total] if total else [])
    if refs:
        kinds = Counter("new tags" if "[new tag]" in r else "new branches" if "[new branch]" in r else "pruned" if "[deleted]" in r else "updated" for r in refs)
        sums.append(f"{len(refs)} refs: " + ", ".join(f"{n} {k}" for k, n in kinds.most_common()))
    cands = [*((0, x) for x in must), *((1, x) for x in fold(other)), *((1, x) for x in sums), *((2, x) for x in hints[:3]), *((2 if ".." in x else 3, x) for x in refs)]
    return shown(o, cands) if cands else ["ok"]


def git_branches(o: Output) -> list[str]:
    if len(o.lines) <= o.most:
        return [x.strip() for x in o.lines] or ["ok"]
    now = next((x[2:].strip() for x in o.lines if x.startswith("* ")), "?")
    groups = Counter((x.lstrip("*+ ").split()[0].rsplit("/", 1)[0] + "/") if "/" in x else "./" for x in o.lines)
    return limited([f"{len(o.lines)} branches (current: {now})", *(f"{g} {n}" for g, n in groups.most_common())], o.most)


def sentence(known: str, say: Callable[[Output], str | None]) -> Callable[[Output], list[str]]:
    """A success in one sentence; raw lines if one of them isn't known, a failure otherwise."""

    def run(o: Output) -> list[str]:
        if o.exit_code:
            return git_transfer(o)
        if all(re.search(known, x) for x in o.lines):
            s = say(o)
            if s:
                return [s]
        return compact(o)

    return run


def _committed(o: Output) -> str | None:
    m = re.search(r"^\[(\S+)(?: \([^)]*\))? ([0-9a-f]{7,})\] (.*)$", o.text, re.M)
    n = re.search(r"(\d+) files? changed(?:, (\d+) insertions?\(\+\))?(?:, (\d+) deletions?\(-\))?", o.text)
    return f"committed {m[2]} on {m[1]}: {m[3]}" + (f" ({n[1]} files +{n[2] or 0} -{n[3] or 0})" if n else "") if m else None


def _pushed(o: Output) -> str | None:
    m = re.search(r"^\s*[*+ ]?\s*(\[new branch\]|\S+\.\.\S+)\s+(\S+) -> (\S+)", o.text, re.M)
    return "up to date" if "up-to-date" in o.text else f"pushed {m[2]} -> {m[3]} {m[1]}" if m else None


def _pulled(o: Output) -> str | None:
    if re.search(r"Already up.to.date", o.text):
        return "already up to date"
    n = re.search(r"(\d+) files? changed.*", o.text)
    return f"pulled: {n[0]}" if n else None


_STEPS = r"^(?:remote: ?|Enumerating|Counting|Compressing|Delta|Writing|Total|To |From |Branch|branch |Everything|\s*[*+ ]?\s*(?:\[|[0-9a-f]{6,}\.))"
git_add = sentence(r"^(?:add|remove) '|^warning: ", lambda o: count(sum(x.startswith("add '") for x in o.lines), "file") + " added" if o.lines else "ok")
git_commit = sentence(r"^\[|files? changed|^ (?:create|delete|rename|rewrite) |^ mode change|^\s*(?:Author|Date):", _committed)
git_push = sentence(_STEPS, _pushed)
git_pull = sentence(_STEPS + r"|^Updating |^Fast-forward|Already up|files? changed|\|\s+\d+|^ (?:create|delete|rename) ", _pulled)


def patch(o: Output) -> list[str]:
    """``files=F hunks=H``, the files' headers, and what failed."""
    fs = diff_files(o.lines)
    fails = [x for x in o.lines if re.search(r"(?i)FAILED|saving rejects|malformed|can't find file|Reversed", x)]
    tool = [x for x in o.lines if re.match(r"^(?:patching file|Hunk #)", x) and x not in fails]
    if not fs and not tool and not fails:
        return compact(o)
    head = [f"files={len(fs) or sum(x.startswith('patching') for x in tool)} hunks={sum(f['hunks'] for f in fs) or sum(x.startswith('Hunk') for x in [*tool, *fails])}"]
    return shown(o, [*((0, x) for x in head + fails), *((1, f"{f['path']} +{f['add']} -{f['del']}") for f in fs), *((2, x) for x in tool)])


# --- hosting ----------------------------------------------------------------------------------------------------------

_CHECK_STATES = (("fail", "fail|failed|failure|error|timed_out|✗|x"), ("cancelled", "cancelled|canceled"), ("pending", r"pending|queued|in_progress|waiting|\*"), ("skipped", "skipped|skipping|neutral|-"), ("pass", "pass|passed|success|✓"))


def checks(o: Output) -> list[str]:
    """The last state of each check: header with counts, then those that fail, were cancelled, or are pending."""
    rows: dict[str, tuple[str, str]] = {}
    seen: Counter = Counter()
    for x in o.lines:
        cells = [c.strip() for c in re.split(r"\t|\s{2,}", x.strip())]
        if len(cells) == 1:
            m = re.match(r"^(\S+): check (\S+)$", cells[0])
            cells = [m[1], m[2]] if m else cells
        if len(cells) < 2:
            continue
        if re.fullmatch(r"[✓✗xX*-]", cells[0]):
            cells = [cells[1], cells[0], *cells[2:]]
        state = next((s for s, p in _CHECK_STATES if re.fullmatch(p, cells[1].lower())), None)
        if state:
            rows[cells[0]] = (state, cells[2] if len(cells) > 2 else "")
            seen[cells[0]] += 1
    if not rows:
        return compact(o)
    n = Counter(s for s, _ in rows.values())
    updates = max(seen.values()) - 1
    head = f"{len(rows)} checks: " + ", ".join(f"{n[s]} {s}" for s in ("fail", "cancelled", "pending", "skipped", "pass") if n[s]) + (f" (watched, {count(updates, 'update')})" if updates else "")
    return limited([head, *(f"{s}: {k}" + (f" ({d})" if d else "") for s in ("fail", "cancelled", "pending") for k, (t, d) in rows.items() if t == s)], o.most, "checks")


def run_log(o: Output) -> list[str]:
    """Messages of each job and step with their number."""

    def source(x: str) -> tuple[str, str]:
        p = x.split("\t")
        return (f"{p[0]}/{p[1]}", re.sub(r"^\S+Z ", "", p[2])) if len(p) >= 3 else ("run", x)

    return by_source(o, source, False)


def item_list(o: Output) -> list[str]:
    """Items by state; those of the rarer states first."""
    v = S.parsed(o.text)
    rs = S.records(v) if isinstance(v, (list, dict)) else []
    if not rs:
        return S.wide_table(o)
    state = [S.get(x, "state", "status", "conclusion") or "?" for x in rs]
    n = Counter(state)
    keep = S.chosen(sorted((i for i in range(len(rs)) if 2 * n[state[i]] <= len(rs)), key=lambda i: (n[state[i]], i)), len(rs), max(1, o.most - 1))
    say = lambda x, s: " ".join(p for p in (f"#{S.get(x, 'number', 'iid', 'databaseId')}", s, S.get(x, "title", "displayTitle", "name"), S.get(x, "author.login", "headRefName")) if p != "#")
    return [f"{count(len(rs), 'item')}: " + ", ".join(f"{c} {s}" for s, c in sorted(n.items(), key=lambda kv: (-kv[1], kv[0]))), *(clip(say(rs[i], state[i])) for i in keep), *more(len(rs) - len(keep), "items")]


def pipelines(o: Output) -> list[str]:
    """``(status) • detail`` rows: counts, all rows but the dominant ones, the first of these."""
    rows = [(m[1], m[0].strip()) for x in o.lines if (m := re.match(r"^\s*\((\w+)\) [•·] .*$", x))]
    if not rows:
        return compact(o)
    n = Counter(s for s, _ in rows)
    top = max(n, key=lambda s: n[s])  # the first seen of equal ones
    odd = [r for s, r in rows if s != top]
    some = [r for s, r in rows if s == top][: max(0, min(3, o.most - 1 - len(odd)))]
    return limited([f"{count(len(rows), 'pipeline')}: " + ", ".join(f"{c} {s}" for s, c in n.items()), *odd, *some], o.most) + more(len(rows) - len(odd) - len(some), "rows")


# --- containers -------------------------------------------------------------------------------------------------------


def container_logs(o: Output) -> list[str]:
    if log_shaped([re.sub(r"^\S+ +\| ?", "", x) for x in o.lines[:40]]):
        return log_summary(Output("\n".join(re.sub(r"^[\w.-]+ +\| ?", "", x) for x in o.lines), o.exit_code, o.most, o.profile, o.command))

    def source(x: str) -> tuple[str, str]:
        m = re.match(r"^([\w./-]+) +\| ?(.*)$", x)
        return (m[1], m[2]) if m else ("log", x)

    return by_source(o, source, True)


def pod_logs(o: Output) -> list[str]:
    if log_shaped(o.lines):
        return log_summary(o)

    def source(x: str) -> tuple[str, str]:
        w = x.split(maxsplit=1)
        return (w[0].strip("[]"), w[1]) if len(w) > 1 and "/" in w[0] else ("log", x)

    return by_source(o, source, False)


def containers(o: Output) -> list[str]:
    rows = []
    for x in o.lines:
        s = "running" if re.search(r"\bUp (?:\d|About|Less)", x) else "exited" if re.search(r"\bExited \(", x) else "other" if re.search(r"\b(?:Created|Restarting|Paused|Dead)\b", x) else ""
        if s and not x.startswith("CONTAINER"):
            cells = re.split(r"\s{2,}", x.strip())
            rows.append((cells[-1], s, next((c for c in cells if re.search(r"Up |Exited|Created|Restarting|Paused|Dead", c)), ""), cells[1] if len(cells) > 1 else ""))
    if not rows:
        return compact(o)
    n = Counter(r[1] for r in rows)
    return limited([f"{count(len(rows), 'container')}: " + ", ".join(f"{n[s]} {s}" for s in ("running", "exited", "other") if n[s]), *(f"{a} {i} {t}" for a, s, t, i in sorted(rows, key=lambda r: (r[1] == "running", r[0])))], o.most, "containers")


_UNITS = {"B": 1, "kB": 1e3, "KB": 1e3, "MB": 1e6, "GB": 1e9}


def images(o: Output) -> list[str]:
    rows = [m for x in o.lines if (m := re.match(r"^(\S+)\s+(\S+)\s+(?:sha256:)?[0-9a-f]{12}\S*\s.*?([0-9.]+)\s?([kKMG]?B)$", x.strip()))]
    if not rows:
        return compact(o)
    size = sorted(((float(m[3]) * _UNITS[m[4]], m) for m in rows), key=lambda r: -r[0])
    none = sum(m[1] == "<none>" for m in rows)
    out = [f"{count(len(rows), 'image')}, {sum(s for s, _ in size) / 1e9:.2f}GB" + (f", {none} dangling" if none else "")]
    named = [f"{m[1]}:{m[2]} {m[3]}{m[4]}" for _, m in size if m[1] != "<none>"]
    return limited(out + named, o.most, "images")


def layers(o: Output) -> list[str]:
    """The last state of each layer in numbers, errors, digest and status."""
    state: dict[str, str] = {}
    for x in o.lines:
        m = re.match(r"^(?:\[[0-9:]+\] )?(?:layer )?([0-9a-f]{8,12}):? (.+)$", x.strip())
        if m:
            state[m[1]] = m[2]
    bad = [x.strip() for x in o.lines if re.search(r"(?i)^error|denied|unauthorized|not found|failed", x)]
    tail = [x.strip() for x in o.lines if re.match(r"^(?:Digest|Status|[\w.-]+: digest):", x.strip())]
    if not state and not bad and not tail:
        return compact(o)
    n = Counter("existed" if "exists" in s.lower() else "pulled" if s.startswith("Pull complete") else "pushed" if s.startswith("Pushed") else "unfinished" for s in state.values())
    return limited([*([f"{count(len(state), 'layer')}: " + ", ".join(f"{c} {k}" for k, c in n.most_common())] if state else []), *fold(bad), *tail], o.most)


def compose(o: Output) -> list[str]:
    """The last state of each resource; blocks of errors between dashes."""
    state: dict[str, str] = {}
    events: Counter = Counter()
    block: list[str] = []
    inside = False
    for x in o.lines:
        m = re.match(r"^\s*(?:✔ |✘ )?((?:Container|Network|Volume|Image)\s+\S+)\s+(\w+)", x)
        if re.match(r"^-{3,}", x.strip()):
            inside = not inside
        elif inside and len(block) < 8:
            block.append(x.strip())
        elif m:
            state[re.sub(r"\s+", " ", m[1])] = m[2]
            events[m[2]] += 1
    bad = [x.strip() for x in o.lines if re.search(r"(?i)\berror\b|failed|unhealthy", x)]
    if not state:
        return Rules(BUILDKIT)(o) if any(x.startswith("#") for x in o.lines) else failure(o) if o.exit_code else compact(o)
    head = f"{count(len(state), 'resource')}: {events['Started']} started, {events['Healthy']} healthy"
    odd = [f"{k} {s}" for k, s in state.items() if s not in ("Creating", "Starting", "Waiting", "Stopping", "Pulling")]
    return shown(o, [(0, head), *((0, x) for x in bad), *((1, x) for x in block), *((2, x) for x in odd)])


def kube_get(o: Output) -> list[str]:
    """Objects of a JSON list by kind with phase, readiness, restarts and replicas; tables compacted."""
    v = S.parsed(o.text)
    items = v.get("items", [v]) if isinstance(v, dict) else None
    if not items:
        return S.wide_table(o)
    out = []
    for x in items:
        cs = (x.get("status") or {}).get("containerStatuses") or []
        ready = f"ready {sum(bool(c.get('ready')) for c in cs)}/{len(cs)}" if cs else ""
        restarts = sum(int(c.get("restartCount") or 0) for c in cs)
        rep = S.get(x, "status.readyReplicas", "status.availableReplicas"), S.get(x, "spec.replicas")
        out.append(" ".join(p for p in (S.get(x, "kind"), S.get(x, "metadata.name"), f"ns={S.get(x, 'metadata.namespace')}" if S.get(x, "metadata.namespace") else "", S.get(x, "status.phase"), ready, f"restarts={restarts}" if restarts else "", f"replicas={rep[0] or 0}/{rep[1]}" if rep[1] else "", S.get(x, "spec.type"), S.get(x, "spec.clusterIP")) if p))
    n = Counter(S.get(x, "status.phase") for x in items)
    odd = [i for i, x in enumerate(items) if n[S.get(x, "status.phase")] * 2 <= len(items)]
    keep = S.chosen(odd, len(out), max(1, o.most - 1))
    return [count(len(out), "object"), *(clip(out[i]) for i in keep), *more(len(out) - len(keep), "objects")]


def kube_describe(o: Output) -> list[str]:
    """Fixed fields, and telling lines of the events."""
    meta = [re.sub(r":\s+", ": ", x.strip()) for x in o.lines if re.match(r"^(?:Name|Namespace|Node|Status|Reason|Message|IP|Controlled By|Replicas):", x)]
    at = next((i for i, x in enumerate(o.lines) if x.startswith("Events:")), len(o.lines))
    ev = [re.sub(r"\s{2,}", " ", x.strip()) for x in o.lines[at + 1 :] if re.search(r"(?i)warning|fail|error|back-?off|unhealthy|evict|kill|oom", x)]
    state = [re.sub(r":\s+", ": ", x.strip()) for x in o.lines[:at] if re.match(r"^\s+(?:State|Last State|Reason|Exit Code|Restart Count|Ready):", x)]
    cands = [*((0, x) for x in meta), *((1, x) for x in fold(ev)), *((2, x) for x in unique(state))]
    return shown(o, cands) if cands else compact(o)


def kube_apply(o: Output) -> list[str]:
    """Verbs with their number and up to three names, and alerts."""
    verbs: dict[str, list[str]] = {}
    alerts = []
    for x in o.lines:
        m = re.match(r"^(\S+) (created|configured|unchanged|deleted|patched|pruned|serverside-applied|replaced)\b", x.strip())
        if m and "/" in m[1]:
            verbs.setdefault(m[2], []).append(m[1])
        elif re.search(r"(?i)error|warning|invalid|forbidden|unable|conflict", x):
            alerts.append(x.strip())
    if not verbs and not alerts:
        return compact(o)
    head = [", ".join(f"{len(v)} {k}" for k, v in verbs.items())] if verbs else []
    some = [f"{k}: " + ", ".join(v[:3]) + (f" (+{len(v) - 3})" if len(v) > 3 else "") for k, v in verbs.items()]
    return shown(o, [*((0, x) for x in head), *((0, x) for x in fold(alerts)), *((1, x) for x in some)])


def kube_rollout(o: Output) -> list[str]:
    wait = [x.strip() for x in o.lines if re.search(r"^(?:\[[0-9:]+\] )?Waiting for ", x)]
    rest = [x.strip() for x in o.lines if not re.search(r"^(?:\[[0-9:]+\] )?Waiting for ", x)]
    return limited([*more(len(wait) - 1, "waiting lines"), *wait[-1:], *fold(rest)], o.most)


def kube_diff(o: Output) -> list[str]:
    fs = diff_files(o.lines)
    if not fs:
        return patch(o)
    return limited([f"{count(len(fs), 'object')} +{sum(f['add'] for f in fs)} -{sum(f['del'] for f in fs)}", *(f"{f['path'].split('/')[-1]} +{f['add']} -{f['del']}" for f in fs)], o.most, "objects")


# --- tests and builds ---------------------------------------------------------------------------------------------------


def go_test(o: Output) -> list[str]:
    """Packages and their failing tests (four each) from test events; other text as a failure."""
    packages: dict[str, dict] = {}
    for x in o.lines:
        e = S.parsed(x) if x.startswith("{") else None
        if not isinstance(e, dict) or "Package" not in e:
            continue
        p = packages.setdefault(e["Package"], {"state": "", "fail": [], "pass": 0, "out": []})
        if e.get("Test"):
            if e.get("Action") == "fail":
                p["fail"].append(e["Test"])
            p["pass"] += e.get("Action") == "pass"
        elif e.get("Action") in ("pass", "fail", "skip"):
            p["state"] = e["Action"]
        if e.get("Action") == "output" and (anchor(str(e.get("Output"))) or re.search(r"panic|FAIL:", str(e.get("Output")))):
            p["out"].append(str(e["Output"]).strip())
    if not packages:
        return text_tests(o)
    bad = {k: p for k, p in packages.items() if p["state"] == "fail" or p["fail"]}
    if not bad:
        return [f"ok: {count(len(packages), 'package')}, {count(sum(p['pass'] for p in packages.values()), 'test')} passed"]
    cands = [(0, f"FAIL {len(bad)} of {count(len(packages), 'package')}")]
    for k, p in bad.items():
        names = list(dict.fromkeys(p["fail"]))
        cands.append((0, f"FAIL {k}: {', '.join(names[:4])}" + (f" (+{len(names) - 4})" if len(names) > 4 else "")))
        cands += [(1, x) for x in unique(p["out"])]
    return shown(o, cands)


def text_tests(o: Output) -> list[str]:
    """Failing tests, their details and totals in the text of any test runner."""
    if o.exit_code == 0 and not any(re.search(r"(?i)\bfail(?:ed|ures?)?\b(?!\s*[:=]?\s*0)", x) for x in o.lines):
        total = last(o, r"(?i)\b\d+ pass(?:ed|ing)?\b|^ok\b|tests?:? +\d+|PASS")
        return limited(([total] if total else []) or fold(o.lines), o.most)
    return failure(o)


def test_json(o: Output) -> list[str]:
    """Counts of suites and tests, and failed ones with the telling lines of their message."""
    start = o.text.find("{")
    v = S.parsed(o.text[start:]) if start >= 0 else S._NONE
    if not isinstance(v, dict) or "numTotalTests" not in v and "testResults" not in v:
        return js_tests(o)
    n = {k: int(v.get(k) or 0) for k in ("numTotalTests", "numPassedTests", "numFailedTests", "numPendingTests", "numFailedTestSuites", "numTotalTestSuites")}
    cands = [(0, f"tests: {n['numFailedTests']} failed, {n['numPassedTests']} passed, {n['numTotalTests']} total; suites: {n['numFailedTestSuites']} failed, {n['numTotalTestSuites']} total")]
    for suite in v.get("testResults") or []:
        bad = [a for a in suite.get("assertionResults") or [] if a.get("status") == "failed"]
        if bad or suite.get("status") == "failed":
            cands.append((0, f"FAIL {'/'.join(str(suite.get('name') or '?').split('/')[-3:])}"))
        for a in bad:
            cands.append((0, f"x {a.get('fullName') or a.get('title')}"))
            for m in a.get("failureMessages") or []:
                ls = [x.strip() for x in str(m).split("\n") if x.strip()]
                cands += [(1, x) for x in ls[:1]] + [(2, x) for x in ls[1:] if anchor(x) or re.match(r"(?i)expected|received|[+-] ", x)][:3]
        if not bad and suite.get("message"):
            cands += [(1, x) for x in str(suite["message"]).split("\n")[:2]]
    return shown(o, cands)


_JS_NAME = re.compile(r"^\s*(?:[✗×✕❯]|FAIL\b|●|\d+\) |not ok)\s*\S")
_JS_SUM = re.compile(r"^\s*(?:Tests|Test Files|Test Suites|Suites|Snapshots)[: ]|^\s*\d+ (?:passing|failing|pending)|^# (?:pass|fail|tests)")


def js_tests(o: Output) -> list[str]:
    """Names of failing tests, totals, details."""
    cands: list[tuple[int, str]] = []
    for x in o.lines:
        t = x.strip()
        if _JS_NAME.search(x):
            cands.append((0, t))
        elif _JS_SUM.search(x):
            cands.append((1, re.sub(r"\s{2,}", " ", t)))
        elif re.search(r"AssertionError|\bError: |^(?:Expected|Received)|expected .* (?:to|received)|ERR!|ELIFECYCLE", t):
            cands.append((2, t))
        elif anchor(t):
            cands.append((3, t))
    if o.exit_code == 0 and not any(c[0] == 0 for c in cands):
        sums = unique(x for t, x in cands if t == 1)
        return limited(sums or fold(o.lines), o.most)
    return shown(o, cands) if cands else failure(o)


def go_mod(o: Output) -> list[str]:
    """Errors and changes of requirements; downloads in numbers."""
    got = sum(bool(re.match(r"^go: (?:downloading|extracting|finding) ", x)) for x in o.lines)
    said = [x.strip() for x in o.lines if re.search(r"(?i)^go: (?:upgraded|added|downgraded|removed)|error|cannot|invalid|not found|unknown|mismatch|fail|verifying", x)]
    rest = [x.strip() for x in o.lines if not re.match(r"^go: (?:downloading|extracting|finding) ", x) and x.strip() not in said]
    cands = [*((0, x) for x in said), *([(1, f"downloaded {count(got, 'module')}")] if got else []), *((2, x) for x in fold(rest))]
    return shown(o, cands) if cands else ["ok"]


def _gradle_ok(o: Output) -> list[str] | None:
    end = last(o, "^BUILD SUCCESSFUL")
    tasks = last(o, r"actionable tasks?")
    n = sum(bool(re.match(r"^> Task ", x)) for x in o.lines)
    return [x for x in (end, tasks, f"{count(n, 'task')} listed" if n else None) if x] if end else None


def _build_ok(o: Output) -> list[str] | None:
    steps = {m[1] for x in o.lines if (m := re.match(r"^#(\d+) (?:\[|DONE|CACHED)", x))}
    if steps:
        return [f"build ok: {count(len(steps), 'step')}"]
    warn = unique(x for x in o.lines if re.search(r"(?i)\bwarning\b", x))
    total = last(o, r"(?i)^\[\s*\d+(?:%|/\d+)\]|BUILD SUCCESS|Build completed|Built target|finished")
    return [*warn[:3], total] if total else None


BUILDKIT = ((0, r"^#?\d* ?ERROR|^ERROR: |failed to solve"), (1, r"^ > \[|^#\d+ \[.*\]"), (2, r"^#\d+ [\d.]+ .*(?i:error|fail|not found)"), (2, r"^\s*\d+ \| >>> "))
TERRAFORM = ((0, r"^Plan: |^Apply complete!|^Destroy complete!|^No changes"), (0, r"^(?:│ )?\s*Error: "), (1, r"^\s*# \S+ (?:will|must) be "), (2, r"^(?:│ )?\s*Warning: "), (3, r"forces replacement"))
BUILD = ((0, r"(?i)\b(?:error|fatal)\b[^:!]{0,200}[:!]|^\*\*\* |FAILED:|^make.*Error|BUILD FAILURE|\[ERROR\]"), (1, r"(?i)undefined reference|ld returned|collect2|CMake Error"), (2, r"(?i)\bwarning\b"), (3, r"^\[\s*\d+(?:%|/\d+)\]"))


def build_system(o: Output) -> list[str]:
    """terraform plans, image builds, and any other build by tiers."""
    if re.search(r"^\s*(?:Terraform|OpenTofu) |^Plan: \d|^\s*# \S+ will be", o.text, re.M):
        return Rules(TERRAFORM, header=r"Error: ", detail=4)(o)
    if re.search(r"^#\d+ ", o.text, re.M):
        return Rules(BUILDKIT, header=r"^ > \[|^-{4,}", detail=12, stop=r"^$", done=_build_ok)(o)
    return Rules(BUILD, header=r"(?i)FAILED:|error:", detail=3, stop=r"^\s*at |^\[\s*\d", frames=max(1, o.most // 3), done=_build_ok)(o)


def cargo_build(o: Output) -> list[str]:
    """Blocks of errors and warnings: header, two places, the first line of code, hints."""
    cands: list[tuple[int, str]] = []
    bad, spans, code = False, 0, False
    for x in o.lines:
        if re.match(r"^(?:error|warning)(?:\[\w+\])?: ", x):
            bad, spans, code = x.startswith("error"), 0, False
            tier = 0 if bad else 4
            if re.match(r"^(?:error: (?:could not compile|aborting)|warning: .* generated \d+)", x):
                tier = 1
            cands.append((tier, x))
        elif re.match(r"^\s*--> ", x):
            spans += 1
            if spans <= 2:
                cands.append((1 if bad else 5, x.strip()))
        elif re.match(r"^\s*\d+ \| ", x) and not code:
            code = True
            cands.append((3 if bad else 7, x.strip()))
        elif re.match(r"^\s*= (?:help|note)|^(?:help|note): ", x):
            cands.append((2 if bad else 6, x.strip()))
        elif re.match(r"^\s*Finished ", x):
            cands.append((1, x.strip()))
    return shown(o, cands) if cands else failure(o) if o.exit_code else compact(o)


def cargo_test(o: Output) -> list[str]:
    """Failing tests, their panics and places, result and rerun hint."""
    return Rules(((0, r"^test .* FAILED|^test result: "), (1, r"panicked at|^assertion|^error"), (2, r"^\s*(?:left|right): |called `"), (3, r"^---- ")), header=r"panicked at", detail=3, stop=r"^note: |^stack", frames=max(1, o.most // 3 + 1), done=lambda o: [x.strip() for x in o.lines if x.startswith("test result:")] or None)(o)


def dotnet_build(o: Output) -> list[str]:
    """All errors, then warnings while lines are left, two totals."""
    strip = lambda x: re.sub(r"\s*\[[^\]]*proj\]$", "", x.strip())
    bad = unique(strip(x) for x in o.lines if re.search(r": error \w+\d+: |^MSBUILD : error", x))
    warn = unique(strip(x) for x in o.lines if re.search(r": warning \w+\d+: ", x))
    sums = unique(x for x in o.lines if re.match(r"^\s*(?:Build (?:FAILED|succeeded)|\d+ (?:Error|Warning)\(s\)|Time Elapsed)", x))[:2]
    cands = [*((0, clip(x, 200)) for x in bad), *((1, x) for x in sums), *((2, clip(x, 200)) for x in warn)]
    return shown(o, cands) if cands else failure(o) if o.exit_code else compact(o)


def dotnet_test(o: Output) -> list[str]:
    """For each failure its name, four lines of message and the first frame; the totals."""
    cands: list[tuple[int, str]] = []
    said, frame = 9, True
    for x in o.lines:
        if re.match(r"^\s*Failed \S", x):
            cands.append((0, x.strip()))
            said, frame = 0, False
        elif re.match(r"^\s*(?:Failed!|Passed!|Total tests|Test Run)", x):
            cands.append((0, x.strip()))
        elif not frame and re.match(r"^\s*at ", x):
            cands.append((2, x.strip()))
            frame = True
        elif said < 4 and not frame and not re.match(r"^\s*(?:Error Message|Stack Trace):", x):
            cands.append((1, x.strip()))
            said += 1
    return shown(o, cands) if cands else text_tests(o)


PYTEST = Rules(((0, r"^(?:FAILED|ERROR) |^=+ .*(?:failed|passed|error|no tests ran).* =+$"), (1, r"^E  +\S"), (2, r"^\S+\.py:\d+: "), (2, r"fixture .* not found|available fixtures")), frames=2, done=lambda o: [x.strip("= ") for x in o.lines if re.match(r"^=+ .*passed.* =+$", x)] or None)
PYTHON = Rules(((0, r"^\S+\.pyi?:\d+(?::\d+)?: "), (1, r"(?i)^found \d+|^success|would reformat|reformatted|All checks passed")), frames=4)
PHP = Rules(((0, r"(?i)^(?:PHP )?(?:fatal|parse) error|^FAILURES!|^There (?:was|were) \d+|^\d+\) "), (1, r"^Tests: \d+|^OK \("), (2, r"\.php:\d+")), frames=4)
CTEST = Rules(((0, r"\*\*\*Failed|^The following tests FAILED|tests failed out of|tests passed"), (1, r"^\s*\d+ - .* \(")))
CLANG = Rules(((0, r":\d+:\d+: (?:fatal )?error: "), (1, r"^\d+ (?:warning|error)s? (?:and \d+ errors? )?generated"), (2, r":\d+:\d+: warning: ")), frames=4)
GO_BUILD = Rules(((0, r"^\S+\.go:\d+(?::\d+)?: "), (1, r"^# |too many errors"), (2, r"(?i)error|undefined|cannot")), frames=2)
GRADLE = Rules(((0, r"^FAILURE: |^> Task .* FAILED|^BUILD (?:FAILED|SUCCESSFUL)|^\* What went wrong"), (1, r"^e: |error: |^> (?!Task|Run|Get)"), (2, r"^\d+ actionable tasks?"), (3, r"^w: |warning: ")), header=r"What went wrong", detail=3, stop=r"^\* ", done=_gradle_ok)
JS_TOOL = Rules(((0, r"(?i)ERR_|npm (?:ERR!|error)|^error\b| ERROR |\b404\b"), (0, r":\d+:\d+\s+error|error TS\d+|^\s*\d+:\d+\s+error"), (1, r"problems? \(|Found \d+ errors?"), (2, r"(?i)\bwarn")), frames=3)
CLOUD_DIFF = Rules(((0, r"^(?:Diagnostics|Resources|Duration|Outputs):|error: "), (0, r"^\s+(?:[+~-] )?\d+ (?:to |unchanged|created|updated|deleted|replaced|errored)|^\s+\d+[ms]"), (1, r"^\s*(?:\+-|-\+|\+|~|-)\s"), (3, r"^(?:Previewing|Updating|View )")))


def tool_workspace(o: Output) -> list[str]:
    return JS_TOOL(o) if o.exit_code else js_tests(o) if any(_JS_SUM.search(x) for x in o.lines) else compact(o)


# --- files --------------------------------------------------------------------------------------------------------------


def listing(o: Output) -> list[str]:
    """Few entries as they are; many by folders and files, three names each, with the number of hidden ones."""
    if any(re.search("[├└]", x) for x in o.lines) or "tree" in o.command.split()[:1]:
        return tree_text(o)
    long = [m for x in o.lines if (m := re.match(r"^(?:\[[0-9:]+\] )?([dl-])[rwxsStT@+.-]{9,}\S*\s.*?(\S+)$", x))]
    names = [(m[2] + ("/" if m[1] == "d" else "")) for m in long if m[2] not in (".", "..")] if long else [x.strip() for x in o.lines if not x.startswith("total ")]
    if len(names) <= max(4, o.most - 1) and not long:
        return names or ["ok"]
    hidden = sum(n.startswith(".") for n in names)
    out = []
    for title, part in (("dirs", sorted(n for n in names if n.endswith("/"))), ("files", sorted(n for n in names if not n.endswith("/")))):
        if part:
            out.append(f"{title}: {len(part)}: " + ", ".join(part[:3]) + (f" +{len(part) - 3}" if len(part) > 3 else ""))
    return out + ([f"hidden: {hidden}"] if hidden else [])


def tree_text(o: Output) -> list[str]:
    """The first level with the number of entries below and two of them; the totals."""
    rows, foot = [], [x.strip() for x in o.lines if re.match(r"^\s*\d+ director", x)]
    root = o.lines[0].strip() if o.lines else ""
    for x in o.lines[1:]:
        m = re.match(r"^((?:[│ ] ? ? ? ?|\xa0)*)[├└][─-]* ?(.*)$", x)
        if m:
            rows.append((len(m[1]) // 4, m[2].strip()))
    if not rows:
        return limited([x.strip() for x in o.lines], o.most)
    out = [root]
    for i, (d, name) in enumerate(rows):
        if d == 0:
            below = []
            for dd, n in rows[i + 1 :]:
                if dd == 0:
                    break
                below.append((dd, n))
            kids = [n for dd, n in below if dd == 1]
            out.append(name + (f" ({len(kids)}: {', '.join(kids[:2])}{', ..' if len(kids) > 2 else ''})" if kids else ""))
    return limited(out, max(o.most, 4)) + foot


_SIGNATURE = re.compile(r"^\s*(?:export |public |private |protected |static |async |pub(?:\([^)]*\))? )*(?:def|class|func|fn|function|interface|type|struct|enum|trait|impl|module|const [A-Z])\b.*")


def read_file(o: Output) -> list[str]:
    """Logs summarised, JSON previewed, code by its signatures, documents by headings, bullets and first sentences."""
    if log_shaped(o.lines):
        return log_summary(o)
    v = S.parsed(o.text) if o.text[:1] in "{[" else S._NONE
    if v is not S._NONE:
        return S.json_value(v, o.most)
    code = [x.rstrip() for x in o.lines if _SIGNATURE.match(x)]
    if len(code) >= 3 and not any(re.match(r"^#{1,6} ", x) for x in o.lines):
        return limited([f"{len(o.lines)} lines, {len(code)} definitions", *(re.sub(r"\s*[{:]\s*$", "", x) for x in code)], o.most)
    cands: list[tuple[int, str]] = []
    heading = False
    for x in o.lines:
        if re.match(r"^#{1,6} ", x) or re.match(r"^[=]{3,}$", x):
            cands.append((0, x))
            heading = True
        elif re.match(r"^\s*(?:[-*+]|\d+\.) ", x) or x.rstrip().endswith(":") or x.startswith("```"):
            cands.append((2, x))
            heading = False
        else:
            if heading:
                cands.append((1, re.split(r"(?<=[.!?])\s", x.strip())[0]))
            heading = False
    return shown(o, cands) if any(t == 0 for t, _ in cands) else limited(o.lines, o.most)


def noisy(path: str) -> str:
    return next((p for p in path.split("/") if p in NOISE_DIRS), "minified" if re.search(r"\.min\.(?:js|css)$", path) else "map" if path.endswith(".map") else "")


def matches(o: Output) -> list[str]:
    """Matches by file with the first of each; noisy folders in numbers."""
    files: dict[str, list] = {}
    noise: Counter = Counter()
    total = 0
    for x in o.lines:
        m = re.match(r"^([^:\s][^:]*):(?:(\d+):)?(?:\d+:)?(.*)$", x)
        if not m:
            continue
        total += 1
        if noisy(m[1]):
            noise[noisy(m[1])] += 1
            continue
        files.setdefault(m[1], [0, m[2], m[3].strip()])[0] += 1
    if not total:
        return compact(o) if o.lines else ["no matches"]
    out = [f"{count(total, 'match', 'matches')} in {count(len(files), 'file')}" + (f", suppressed {sum(noise.values())} in " + ", ".join(f"{k} ({n})" for k, n in noise.items()) if noise else "")]
    cands = [(0, out[0]), *((1, clip(f"{f}:{n or ''}: {t}" + (f" (+{c - 1} more)" if c > 1 else ""), 120)) for f, (c, n, t) in files.items())]
    kept, lost = fit(cands, o.most, o.budget)
    return kept + more(lost, "files")


def paths(o: Output) -> list[str]:
    """Few paths as they are; many by folder and extension, noisy folders in numbers."""
    ps = [x.strip() for x in o.lines if not re.match(r"^\[?[0-9:]+\]", x.strip())]
    good = [p for p in ps if not noisy(p)]
    noise = Counter(noisy(p) for p in ps if noisy(p))
    tail = ["suppressed " + ", ".join(f"{n} in {k}" for k, n in noise.most_common())] if noise else []
    if len(good) <= max(16, o.most - 1) and len(ps) <= 16:
        return good + tail or ["no paths"]
    dirs = Counter(folder(p.removeprefix("./")) for p in good)
    exts = Counter(extension(p) for p in good)
    out = [f"{count(len(good), 'path')}", "extensions: " + ", ".join(f"{e} {n}" for e, n in exts.most_common(5))]
    return limited(out + [f"{d} {n}" for d, n in dirs.most_common()], o.most, "dirs") + tail


def summary(o: Output) -> list[str]:
    """Without a known tool: by what the text looks like."""
    if not o.lines:
        return ["ok"]
    if log_shaped(o.lines):
        return log_summary(o)
    if o.text.lstrip()[:1] in "{[" and S.parsed(o.text) is not S._NONE:
        return S.json_query(o)
    return failure(o) if o.exit_code else compact(o)


def view(o: Output) -> list[str]:
    v = S.parsed(o.text)
    return S.json_value(v, o.most) if isinstance(v, (dict, list)) else read_file(o)


def top(o: Output) -> list[str]:
    return S.wide_table(o)


REDUCERS: dict[str, Callable[[Output], list[str]]] = {
    "go-test-json": go_test, "go-build": GO_BUILD, "go-lint": GO_BUILD, "go-mod": go_mod, "generic-test": text_tests, "generic-summary": summary,
    "directory-listing": listing, "cat-read": read_file, "ripgrep": matches, "grep": matches, "ripgrep-files": paths, "ripgrep-files-with-matches": paths, "path-find": paths,
    "git-ls-files": paths, "git-status": git_status, "git-log": git_log, "git-diff": git_diff, "git-show": git_diff, "git-add": git_add, "git-commit": git_commit, "git-push": git_push,
    "git-pull": git_pull, "git-branch": git_branches, **{f"git-{x}": git_transfer for x in ("fetch", "clone", "merge", "rebase", "checkout", "reset", "stash", "cherry-pick", "revert")},
    "gh-pr-view": view, "gh-pr-checks": checks, "gh-item-list": item_list, "gh-run-log": run_log, "gh-run-list": S.wide_table, "gh-run-view": run_log, "gh-api": S.json_query, "glab-pipeline": pipelines,
    "bun-test": js_tests, "js-package-test": js_tests, "js-workspace": tool_workspace, "vitest-json": test_json, "jest-json": test_json, "node-eval": summary, "pytest": PYTEST, "python-tooling": PYTHON,
    "cargo-test": cargo_test, "cargo-build": cargo_build, "dotnet-test": dotnet_test, "dotnet-build": dotnet_build, "build-system": build_system, "gradle-build": GRADLE, "pulumi-diff": CLOUD_DIFF,
    "ctest": CTEST, "clang-tooling": CLANG, "php-tooling": PHP, "patch-diff": patch, "docker-images": images, "docker-transfer": layers, "docker-activity": compose, "docker-ps": containers, "docker-logs": container_logs,
    "kubectl-get": kube_get, "kubectl-describe": kube_describe, "kubectl-logs": pod_logs, "kubectl-top": top, "kubectl-events": S.wide_table, "kubectl-apply": kube_apply, "kubectl-rollout": kube_rollout, "kubectl-diff": kube_diff,
    "aws-log-events": S.log_events, "aws-lambda-functions": S.lambda_functions, "aws-stack-events": S.stack_events, "aws-s3-ls": S.objects, "aws-ecs-state": S.cloud_list, "vercel-deployments": S.cloud_list, "cloud-list": S.cloud_list,
    "supabase-function-logs": S.cloud_logs, "heroku-router-logs": S.cloud_logs, "cloud-logs": S.cloud_logs, "http-api": S.http_exchange, "json-query": S.json_query, "sql-query": S.sql_output, "csv-tabular": S.wide_table, "env-print": S.env_dump,
}


def reduced(text: str | None, profile: str | None, exit_code: int | None = 0, most: int = 12, command: str = "") -> str:
    """A text by the reducer of its profile; profiles without one, and texts that a reducer can't read, by what they look like."""
    o = Output(text or "", int(exit_code or 0), most, profile or "", command)
    if not o.lines:
        return ""
    if profile == "passthrough":
        return o.text.strip()
    try:
        return "\n".join(x for x in REDUCERS.get(profile or "", summary)(o) if x)
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):  # a shape that the tool doesn't usually have
        return "\n".join(summary(o))
