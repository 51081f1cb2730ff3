"""Reducers of structured output: JSON values and streams, tables, results of databases, listings of clouds."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from typing import Any

from linelore.operators.tables import KEY_NAMES, KEY_PARTS
from linelore.reducers.base import Output, clip, compact, failure, fold, limited, log_summary, more, packed, shown, times

MAX_DEPTH = 4
TABLE_ITEMS, TABLE_SHARE, TABLE_COLUMNS, TABLE_CELL = 5, 80, 10, 64
_NONE = object()


def priority(key: str) -> int:
    """The same as ``operators.tables.key_priority``."""
    k = key.lower().replace("-", "_").replace(" ", "_")
    for n, names in enumerate(KEY_NAMES):
        if k in names:
            return n
    return next((n for n, part in KEY_PARTS if re.search(part, k)), 100)


def ordered_keys(o: dict) -> list[str]:
    return sorted(o, key=lambda k: (priority(k), k))


def parsed(text: str) -> Any:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return _NONE


def scalar(v: Any, width: int = 64) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return clip(v, width) if isinstance(v, str) else repr(v)


def brief(v: Any) -> str:
    """A value in a few characters."""
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k}={brief(v[k]) if not isinstance(v[k], (dict, list)) else '..'}" for k in ordered_keys(v)[:4]) + (", .." if len(v) > 4 else "") + "}"
    return f"[{len(v)} items]" if isinstance(v, list) else scalar(v)


def kind(v: Any) -> str:
    return "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"


def structure(value: Any, most: int = 40) -> list[str]:
    """Keys and types, four levels deep; an array is shown by its first element."""
    out: list[str] = []

    def walk(label: str, v: Any, depth: int) -> None:
        pad = "  " * depth
        if isinstance(v, dict) and v:
            if depth >= MAX_DEPTH:
                out.append(f"{label}{{... {len(v)} keys}}")
                return
            out.append(label + "{")
            for k in ordered_keys(v):
                walk(f"{pad}  {k}: ", v[k], depth + 1)
            out.append(pad + "}")
        elif isinstance(v, list) and v:
            if depth >= MAX_DEPTH:
                out.append(f"{label}[{len(v)} items]")
                return
            out.append(label + "[")
            walk(pad + "  ", v[0], depth + 1)
            if len(v) > 1:
                out.append(f"{pad}  ... +{len(v) - 1} more items")
            out.append(pad + "]")
        else:
            out.append(label + ("{}" if v == {} else "[]" if v == [] else kind(v)))

    walk("", value, 0)
    return out[:most] + more(len(out) - most)


def preview(value: Any, most: int = 8) -> list[str]:
    """Paths with their values; arrays with their length and up to three samples."""
    out: list[str] = []

    def walk(path: str, v: Any, depth: int) -> None:
        if len(out) > most:
            return
        if isinstance(v, dict):
            out.append(f"{path}: object keys={len(v)}")
            for k in ordered_keys(v):
                walk(f"{path}.{k}", v[k], depth + 1)
        elif isinstance(v, list):
            sample = ", ".join(brief(x) for x in v[:3]) + (", ..." if len(v) > 3 else "")
            out.append(f"{path}: array len={len(v)}" + (f" sample=[{sample}]" if v else ""))
            if v and depth < 1 and isinstance(v[0], (dict, list)):
                walk(path + "[0]", v[0], depth + 1)
        else:
            out.append(f"{path}={scalar(v)}")

    walk("root", value, 0)
    return out[:most] + (["... more values"] if len(out) > most else [])


def rare_rows(rows: Sequence[Sequence[str]]) -> list[int]:
    """Rows that hold a rare value (a twentieth of the rows or fewer) of a column with two to eight values; the rarest first."""
    n = len(rows)
    if n < 8:
        return []
    best: dict[int, int] = {}
    for c in range(max(map(len, rows))):
        seen = Counter(r[c] if c < len(r) else "" for r in rows)
        if 2 <= len(seen) <= 8:
            for i, r in enumerate(rows):
                k = seen[r[c] if c < len(r) else ""]
                if k <= max(1, n // 20):
                    best[i] = min(k, best.get(i, k))
    return sorted(best, key=lambda i: (best[i], i))


def chosen(first: Iterable[int], total: int, most: int) -> list[int]:
    """Places that are shown: the marked ones, then the leading ones, in order."""
    keep = dict.fromkeys(list(dict.fromkeys(first))[:most])
    for i in range(total):
        if len(keep) >= most:
            break
        keep[i] = None
    return sorted(keep)


def uniform_table(items: Sequence[Any], most: int = 12, label: str = "array") -> list[str] | None:
    """Objects of one shape as a table, odd ones and rare values first; None if they are too few or too different.

    Five items and four fifths of them with one set of at least two keys are needed; of equally frequent sets the
    smallest counts. A row behind a gap begins with its number.
    """
    sets = Counter("\0".join(sorted(x)) for x in items if isinstance(x, dict))
    if len(items) < TABLE_ITEMS or not sets:
        return None
    top, n = min(sets.items(), key=lambda kv: (-kv[1], kv[0]))
    cols = sorted(top.split("\0"), key=lambda k: (priority(k), k))
    if n * 100 < len(items) * TABLE_SHARE or len(cols) < 2:
        return None
    use = cols[:TABLE_COLUMNS]
    fits = [isinstance(x, dict) and "\0".join(sorted(x)) == top for x in items]
    cells = [[clip(brief(x[c]), TABLE_CELL).replace("\n", " ") for c in use] if ok else [] for x, ok in zip(items, fits)]
    room = len(items) if len(items) <= most - 1 else max(3, most - 2)
    same = [i for i, ok in enumerate(fits) if ok]
    rare = [same[i] for i in rare_rows([cells[i] for i in same])] if len(items) > room else []
    keep = chosen([*(i for i, ok in enumerate(fits) if not ok), *rare], len(items), room)
    out = [f"{label} len={len(items)} uniform objects, cols: {'|'.join(use)}" + (f" (+{len(cols) - len(use)} more cols)" if len(cols) > len(use) else "")]
    last = -1
    for i in keep:
        out.append(f"#{i} {brief(items[i])}" if not fits[i] else ("" if i == last + 1 else f"#{i} ") + "|".join(cells[i]))
        last = i
    return out + more(len(items) - len(keep), "rows")


def json_value(v: Any, most: int, label: str = "array") -> list[str]:
    return (uniform_table(v, most, label) if isinstance(v, list) else None) or preview(v, most)


def json_query(o: Output) -> list[str]:
    """One value as table or preview; a value a line as one table or line by line; anything else compacted."""
    v = parsed(o.text)
    if v is not _NONE and isinstance(v, (dict, list)):
        return json_value(v, o.most)
    vs = [parsed(x) for x in o.lines]
    if len(vs) > 1 and all(isinstance(x, (dict, list)) for x in vs):
        t = uniform_table(vs, o.most, "stream")
        return t or limited([brief(x) for x in vs], o.most)
    return failure(o) if o.exit_code else compact(o)


# --- tables ---------------------------------------------------------------------------------------------------------

_CELLS = re.compile(r"\t+|\s{2,}")
_DETAIL = ("status", "state", "ready", "restarts", "age", "size", "used", "avail", "use%", "type", "version", "command", "%cpu", "%mem", "pid")
_KEY = ("name", "id", "filesystem", "mounted on", "command", "path", "repository", "namespace")


def wide_table(o: Output) -> list[str]:
    """``rows: N columns: ...`` and rows as key and details, rare ones first."""
    if re.match(r"\s*(?:sudo )?du\b", o.command) or (o.lines and all(re.match(r"^\s*[\d.]+[KMGT]?B?\s+\S", x) for x in o.lines)):
        rows = [re.split(r"\s+", x.strip(), maxsplit=1) for x in o.lines]
        rows = [r for r in rows if len(r) == 2]
        return limited([f"rows: {len(rows)} columns: size, path", *(f"{p} {s}" for s, p in rows)], o.most, "rows")
    rows = [[c for c in _CELLS.split(x.strip()) if c] for x in o.lines]
    rows = [r for r in rows if len(r) >= 2]
    if len(rows) < 2:
        return compact(o)
    head, body = [c.lower() for c in rows[0]], rows[1:]
    key = next((head.index(k) for k in _KEY if k in head), 0)
    details = ([i for d in _DETAIL for i, c in enumerate(head) if c == d and i != key] + [i for i in range(len(head)) if i != key])[:8]
    details = sorted(dict.fromkeys(details[:4]))
    keep = chosen(rare_rows([[r[i] if i < len(r) else "" for i in details] for r in body]), len(body), max(1, o.most - 1))
    say = lambda r: " ".join([r[key] if key < len(r) else r[0], *(f"{head[i]}={r[i]}" for i in details if i < len(r))])
    return [f"rows: {len(body)} columns: {', '.join(head)}", *(clip(say(body[i])) for i in keep), *more(len(body) - len(keep), "rows")]


_BORDER = re.compile(r"^[+|\-=\s─│┼]+$")
_SQL_ERROR = re.compile(r"(?i)^(?:error|fatal|panic)\b|syntax error|^.*: error:")
_SQL_SUM = re.compile(r"(?i)^\(?\d+ rows?\b|^(?:INSERT|UPDATE|DELETE|SELECT|CREATE|DROP) ?\d*|^Query OK")
_SQL_NOISE = re.compile(r"(?i)^(?:timing is|output format is|using database|time: )")


def sql_output(o: Output) -> list[str]:
    """The output of a database client: errors and summaries, or rows with rare values first and their number."""
    body, sums, bad = [], [], []
    for x in o.lines:
        if _SQL_NOISE.search(x) or _BORDER.match(x):
            continue
        (bad if _SQL_ERROR.search(x) else sums if _SQL_SUM.search(x.strip()) else body).append(x)
    if bad or not body:
        return limited(fold([*bad, *sums]), o.most)
    sep = next((d for d in ("|", "\t", ",") if sum(d in x for x in body) * 3 >= len(body) * 2), None)
    rows = [[c.strip() for c in x.strip().strip("|").split(sep)] if sep else re.split(r"\s{2,}", x.strip()) for x in body]
    width = min(Counter(map(len, rows)).items(), key=lambda kv: (-kv[1], kv[0]))[0]
    rows = [r for r in rows if len(r) == width]
    head, rest = rows[0], rows[1:]
    keep = chosen(rare_rows(rest), len(rest), max(1, o.most - 2))
    out = [f"rows: {len(rest)} columns: {', '.join(head)}"]
    out += [clip(" | ".join(rest[i])) for i in keep]
    return out + more(len(rest) - len(keep), "rows") + [x.strip() for x in sums[:1]]


_SECRET = re.compile("KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL")
_DIAGNOSTIC = ("PWD", "HOME", "SHELL", "USER", "LANG", "CI", "VIRTUAL_ENV", "NODE_ENV", "JAVA_HOME")


def env_dump(o: Output) -> list[str]:
    """PATH's first folders, telling variables, secrets by their length, other names by prefix."""
    vs = dict(x.split("=", 1) for x in o.lines if re.match(r"^[A-Za-z_]\w*=", x))
    if not vs:
        return compact(o)
    out = [f"{len(vs)} variables"]
    if "PATH" in vs:
        dirs = vs["PATH"].split(":")
        out.append("PATH: " + ":".join(dirs[:4]) + (f" (+{len(dirs) - 4} dirs)" if len(dirs) > 4 else ""))
    out += packed([f"{k}={clip(vs[k], 40)}" for k in _DIAGNOSTIC if k in vs])
    secret = [k for k in sorted(vs) if _SECRET.search(k.upper())]
    out += packed([f"{k}=<redacted len={len(vs[k])}>" for k in secret])
    groups: dict[str, list[str]] = {}
    for k in sorted(set(vs) - set(secret) - set(_DIAGNOSTIC) - {"PATH"}):
        groups.setdefault(k.split("_")[0], []).append(k)
    many = [f"{p}_* ({len(ks)})" for p, ks in groups.items() if len(ks) > 1]
    out += packed([*many, *(ks[0] for ks in groups.values() if len(ks) == 1)])
    return limited(out, max(o.most, 8))


_STATUS = re.compile(r"^(?:< ?)?HTTP/\S+ \d{3}.*")
_HEADER = re.compile(r"(?i)^(?:< ?)?(?:content-type|location|retry-after): .*")
_TRANSPORT = re.compile(r"^(?:\*|>|<|\{ \[|\} \[|\s*%|\s*\d+ +\d+|  0)")


def http_exchange(o: Output) -> list[str]:
    """The last status line, content type and location, and the body as JSON or compacted."""
    status, heads, body = [], [], []
    for x in o.lines:
        if _STATUS.match(x):
            status.append(x.lstrip("< "))
            heads = []
        elif _HEADER.match(x):
            heads.append(x.lstrip("< "))
        elif not _TRANSPORT.match(x) and not (status and not body and re.match(r"^[A-Za-z][\w-]*: ", x)):
            body.append(x)
    out = [*status[-1:], *heads]
    v = parsed("\n".join(body))
    room = max(3, o.most - len(out))
    if v is not _NONE and isinstance(v, (dict, list)):
        return out + json_value(v, room)
    return limited(out + fold(body), o.most)


# --- clouds ---------------------------------------------------------------------------------------------------------

# Keys under which list calls put their records, in the order in which they are looked for. Fixed values.
COLLECTIONS = ("Functions", "Reservations", "StackEvents", "Events", "events", "services", "Services", "Contents", "Buckets", "deployments", "items", "Items", "value", "results", "data", "resources", "clusters", "instances")


def get(v: Any, *paths: str) -> str:
    """The first of several dotted paths that holds something."""
    for p in paths:
        x = v
        for k in p.split("."):
            x = x.get(k) if isinstance(x, dict) else None
        if x not in (None, "", [], {}):
            return x if isinstance(x, str) else json.dumps(x)
    return ""


def records(v: Any) -> list[dict]:
    """The records of a list call: the value itself, the first known collection, or instances within reservations."""
    if isinstance(v, list):
        return [x for x in v if isinstance(x, dict)]
    if not isinstance(v, dict):
        return []
    for k in COLLECTIONS:
        if isinstance(v.get(k), list):
            rs = [x for x in v[k] if isinstance(x, dict)]
            return [y for x in rs for y in x.get("Instances", [x])] if k == "Reservations" else rs
    lists = [x for x in v.values() if isinstance(x, list) and x and isinstance(x[0], dict)]
    return lists[0] if lists else [v]


def label(x: dict) -> str:
    """A record's name: its name or id, or the last part of its resource name or address."""
    s = get(x, "name", "Name", "FunctionName", "DBInstanceIdentifier", "InstanceId", "serviceName", "Key", "title", "id", "Id", "uid", "metadata.name")
    return s or get(x, "arn", "Arn", "ARN", "url", "selfLink").rstrip("/").split("/")[-1].split(":")[-1] or brief(x)


def cloud_list(o: Output) -> list[str]:
    """Number of records by state; records whose state isn't the one of most come first."""
    v = parsed(o.text)
    rs = records(v) if v is not _NONE else []
    if not rs:
        return failure(o) if o.exit_code else wide_table(o)
    state = [get(x, "status", "Status", "state", "State.Name", "State", "DBInstanceStatus", "lifecycleState", "readyState", "provisioningState") for x in rs]
    seen = Counter(s for s in state if s)
    head = f"{len(rs)} records" + (": " + ", ".join(f"{n} {s}" for s, n in sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))) if seen else "")
    top = next((s for s, n in seen.items() if 2 * n > len(rs)), None)
    keep = chosen([i for i, s in enumerate(state) if s and s != top] if top else [], len(rs), max(1, o.most - 1))
    detail = lambda x: get(x, "region", "Region", "location", "zone", "Placement.AvailabilityZone", "type", "InstanceType", "engine", "Engine")
    return [head, *(clip(" ".join(p for p in (label(rs[i]), state[i], detail(rs[i])) if p)) for i in keep), *more(len(rs) - len(keep), "items")]


def lambda_functions(o: Output) -> list[str]:
    """Number, runtimes and total size of functions, and each with runtime, memory and size."""
    rs = records(parsed(o.text)) if parsed(o.text) is not _NONE else []
    if not rs:
        return failure(o)
    size = sum(int(x.get("CodeSize") or 0) for x in rs)
    seen = Counter(get(x, "Runtime") or "image" for x in rs)
    odd = [i for i, x in enumerate(rs) if get(x, "State") not in ("", "Active")]
    keep = chosen(odd, len(rs), max(1, o.most - 1))
    say = lambda x: " ".join(p for p in (label(x), get(x, "Runtime"), f"{x['MemorySize']}MB" if x.get("MemorySize") else "", human(int(x.get("CodeSize") or 0)), get(x, "State") if get(x, "State") != "Active" else "") if p)
    return [f"{len(rs)} functions, {human(size)}: " + ", ".join(f"{n} {r}" for r, n in sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))), *(say(rs[i]) for i in keep), *more(len(rs) - len(keep), "items")]


def human(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.0f}B" if unit == "B" else f"{n:.1f}{unit}"
        n /= 1024
    return f"{n:.1f}TB"


def template(message: str) -> str:
    """The same as ``functions.text.template_key``."""
    return " ".join("#" if re.fullmatch(r"[0-9a-fA-F-]{8,}", t) and re.search(r"\d", t) else re.sub(r"\d+", "N", t) for t in message.split())


_BAD = re.compile(r"(?i)error|exception|fatal|timed? ?out|fail|denied|critical")


def log_events(o: Output) -> list[str]:
    """Log events by the template of their message; templates of errors lead."""
    v = parsed(o.text)
    rs = records(v) if v is not _NONE else []
    if not rs:
        return log_summary(o)
    groups: dict[str, list] = {}
    for x in rs:
        m = get(x, "message", "Message").strip()
        groups.setdefault(template(m), [0, m])[0] += 1
    cands = [(0, f"{len(rs)} events, {len(groups)} templates")]
    for t, (n, m) in sorted(groups.items(), key=lambda kv: (not _BAD.search(kv[0]), -kv[1][0])):
        cands.append((1 if _BAD.search(t) else 2, times(m if n == 1 else t, n)))
    return shown(o, cands, "templates")


def stack_events(o: Output) -> list[str]:
    """Events of a stack by status; failures with their reason, equal ones once."""
    v = parsed(o.text)
    rs = records(v) if v is not _NONE else []
    if not rs:
        return failure(o)
    seen = Counter(get(x, "ResourceStatus") for x in rs)
    bad = Counter((get(x, "LogicalResourceId"), get(x, "ResourceStatus"), get(x, "ResourceStatusReason")) for x in rs if "FAILED" in get(x, "ResourceStatus") or "ROLLBACK" in get(x, "ResourceStatus"))
    head = f"{len(rs)} events: " + ", ".join(f"{n} {s}" for s, n in sorted(seen.items(), key=lambda kv: (-kv[1], kv[0])))
    return limited([head, *(times(" ".join(p for p in k if p), n) for k, n in bad.items())], o.most)


def objects(o: Output) -> list[str]:
    """A listing of stored objects: number, total size, the largest ones; buckets by name."""
    rows = [re.match(r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\s+(\d+)\s+(.+)$", x) for x in o.lines]
    rows = [(int(m[2]), m[3]) for m in rows if m]
    prefixes = [x.split("PRE ", 1)[1].strip() for x in o.lines if x.strip().startswith("PRE ")]
    if not rows and not prefixes:
        return compact(o)
    big = sorted(rows, key=lambda r: (-r[0], r[1]))[: max(1, o.most - 2)]
    out = [f"{len(rows)} objects, {human(sum(s for s, _ in rows))}"] + ([f"prefixes: {', '.join(prefixes[:5])}" + (f" (+{len(prefixes) - 5})" if len(prefixes) > 5 else "")] if prefixes else [])
    return out + [f"{human(s)} {p}" for s, p in big] + more(len(rows) - len(big), "objects")


def cloud_logs(o: Output) -> list[str]:
    """Lines or events of hosted functions and routers: sources, time span, and failing signatures by number."""
    v = parsed(o.text)
    rs = records(v) if v is not _NONE and isinstance(v, (dict, list)) else []
    if rs:
        ev = [(get(x, "timestamp", "time", "ts"), get(x, "source", "function_id", "service", "metadata.function_id"), get(x, "level", "severity", "metadata.level"), get(x, "message", "event_message", "msg", "status")) for x in rs]
    else:
        ev = []
        for x in o.lines:
            m = re.match(r"^(\S+T\S+) (\S+?): (.*)$", x)
            ev.append((m[1], m[2], "", m[3]) if m else ("", "", "", x))
    stamps, sources = [e[0] for e in ev if e[0]], list(dict.fromkeys(e[1] for e in ev if e[1]))
    seen = Counter((s, template(m)) for _, s, lv, m in ev if _BAD.search(lv) or _BAD.search(m) or re.search(r"status=[45]\d\d|at=error| [45]\d\d ", m))
    head = f"{len(ev)} events" + (f", {len(sources)} sources" if sources else "") + (f", {min(stamps)}..{max(stamps)}" if stamps else "")
    cands = [(0, head), *((1, times(f"{s}: {m}" if s else m, n)) for (s, m), n in sorted(seen.items(), key=lambda kv: (-kv[1], kv[0])))]
    if not seen:
        cands += [(2, times(m, n)) for m, n in Counter(template(e[3]) for e in ev).most_common(3)]
    return shown(o, cands, "signatures")
