"""Text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as trimming and word splitting understand it, and terminal sequences.
SPACE = r"\s\x0B\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ANSI = r"\x1B(?:\[[^@-~]*(?:[@-~]|$)|[\]PX^_](?:[^\x07\x1B]|\x1B(?!\\))*(?:\x07|\x1B\\|$)|[ -/]*(?:[0-~]|$))"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
LEVEL_TOKENS = "INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL"
# Extensions of source files in the order in which they are looked for.
ANCHOR_EXTENSIONS = "go py rs ts tsx mts cts js jsx mjs cjs php phtml java c cc cpp h hpp rb kt kts swift scala cs ex exs erl m mm lua dart clj sh bash zig vue svelte".split()
SEVERITIES = {
    "fatal": "FATAL", "panic": "FATAL", "critical": "FATAL", "crit": "FATAL", "error": "ERROR", "err": "ERROR", "warn": "WARN", "warning": "WARN",
    "info": "INFO", "debug": "DEBUG", "trace": "TRACE",
}


def let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+$", "")


def collapse(c: Column) -> Column:
    """Trimmed, with single spaces between words."""
    return F.regexp_replace(trim(c), f"[{SPACE}]+", " ")


def strip_ansi(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\x1b")), F.regexp_replace(c, ANSI, "")).otherwise(c)


def clip(c: Column, n: int) -> Column:
    """The first n characters and an ellipsis, if it has more."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def estimate_tokens(c: Column) -> Column:
    """Tokens by the engine's unit: a quarter of the bytes, or the runs of word and symbol characters if that is more."""
    wordy = F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))
    signs = F.size(F.regexp_extract_all(c, F.lit(r"[^A-Za-z0-9 \n\r\t\f\x0B]+"), F.lit(0)))
    more = F.aggregate(wordy, F.lit(0), lambda a, x: a + F.when(F.length(x) > 12, ((F.length(x) - 9) / 8).cast("int")).otherwise(0))
    lexical = F.greatest(F.lit(1), F.size(wordy) + more + F.floor((signs + 1) / 2).cast("int"))
    return F.when(F.octet_length(c) == 0, 0).otherwise(F.greatest(F.ceil(F.octet_length(c) / 4), lexical)).cast("bigint")


def _clock(t: Column) -> Column:
    return t.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?$")


def _moment(t: Column) -> Column:
    iso = lambda x: (F.length(x) >= 20) & (F.substring(x, 5, 1) == "-") & (F.substring(x, 8, 1) == "-") & x.rlike("[T_]")
    return t.rlike("[0-9]") & let(F.regexp_replace(t, r"^[\[\]]+|[\[\]]+$", ""), lambda x: iso(x) | _clock(x) | x.rlike(r"^(?:[0-9]{10}|[0-9]{13})$"))


def _without_moment(w: Column) -> Column:
    syslog = (F.size(w) >= 3) & F.get(w, F.lit(0)).rlike(f"^(?:{MONTHS})$") & F.get(w, F.lit(1)).rlike("^[0-9]{1,2}$") & _clock(F.get(w, F.lit(2)))
    n = F.when(syslog, 3).when((F.size(w) >= 1) & _moment(F.get(w, F.lit(0))), 1).otherwise(0)
    return let(n, lambda k: F.when((k > 0) & (k < F.size(w)), F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0)))).otherwise(w))


def _without_counter(text: Column) -> Column:
    last = F.regexp_replace(F.substring_index(text, " ", -1), r"^[\[({})\]]+|[\[({})\]]+$", "")
    counter = text.contains(" ") & last.rlike(r"^[0-9.,/:-]*[0-9][0-9.,/:-]*s?(?:ms)?%?$")
    return F.when(counter, F.regexp_replace(text, " [^ ]*$", "")).otherwise(text)


def _key_of_words(w: Column) -> Column:
    first = F.get(w, F.lit(0))
    leveled = (F.size(w) >= 2) & F.upper(F.regexp_replace(first, r"^[\[\]:]+|[\[\]:]+$", "")).rlike(f"^(?:{LEVEL_TOKENS})$")
    rest = F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
    parts = F.when(leveled, F.concat(F.array(first), let(rest, _without_moment))).otherwise(_without_moment(w))
    return let(F.array_join(parts, " "), _without_counter)


def similar_line_key(line: Column) -> Column:
    """What must be equal for two lines to be similar: without leading time and trailing counter, but with the level."""
    return let(F.split(collapse(line), " "), _key_of_words)


def template_key(message: Column) -> Column:
    """A message with its variable parts replaced: hexadecimal words of eight or more by ``#``, digits by ``N``."""
    token = lambda t: F.when(t.rlike("^[0-9a-fA-F-]{8,}$") & t.rlike("[0-9]"), F.lit("#")).otherwise(F.regexp_replace(t, "[0-9]+", "N"))
    return F.array_join(F.transform(F.split(collapse(message), " "), token), " ")


def anchor(line: Column) -> Column:
    """The first ``file.ext:`` reference of a line, widened to its delimiters; extensions go first in their order; empty for none."""
    found = [F.nullif(F.regexp_extract(line, rf"(?i)^.*?([^ \t(\[{{\"']*\.{x}:[^ \t)\]}}\"']*)", 1), F.lit("")) for x in ANCHOR_EXTENSIONS]
    inline = F.nullif(F.regexp_extract(line, r"(?i)(\[(?:eval|stdin)\]:[0-9][^ \t)\]}\"']*)", 1), F.lit(""))
    quick = line.rlike(r"(?i)\.(?:" + "|".join(ANCHOR_EXTENSIONS) + "):")
    return F.when(quick, F.coalesce(*found)).otherwise(F.coalesce(inline, F.lit("")))


def _severity_of_words(w: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    token = lambda t: F.substring_index(F.lower(F.regexp_replace(t, r"^[\[\]()<>:,;|*]+|[\[\]()<>:,;|*]+$", "")), "=", -1)
    dated = (F.size(w) >= 3) & F.get(w, F.lit(0)).rlike(r"^[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}$") & _moment(F.get(w, F.lit(1)))
    rest = F.when(dated, F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0)))).otherwise(_without_moment(w))
    found = F.filter(F.transform(F.slice(rest, 1, 3), lambda t: F.element_at(names, token(t))), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit("other"))


def severity(line: Column) -> Column:
    """The level among the first three words behind a line's time, or ``other``."""
    return let(F.split(collapse(line), " "), _severity_of_words)


def severity_and_key(line: Column) -> Column:
    """``struct<severity, key>``: both from one division of the line into words."""
    return let(F.split(collapse(line), " "), lambda w: F.struct(_severity_of_words(w).alias("severity"), _key_of_words(w).alias("key")))


def shorten_path(p: Column) -> Column:
    """The last three segments of a path."""
    s = F.filter(F.split(p, r"[/\\]"), lambda x: x != "")
    return F.when(F.size(s) > 3, F.concat(F.lit(".../"), F.array_join(F.slice(s, -3, 3), "/"))).otherwise(p)


def humanize_bytes(n: Column) -> Column:
    """Bytes with one decimal and a unit."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.format_string("%.1f" + unit, n / float(1024**k))).otherwise(out)
    return out


def redact(name: Column, value: Column) -> Column:
    """Values of variables that hold secrets, replaced by their length."""
    return F.when(F.upper(name).rlike("KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL"), F.format_string("<redacted len=%d>", F.length(value))).otherwise(value)


def project_directory(path: Column) -> Column:
    """How a working directory is spelled as a folder of transcripts."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


# Ordered rules that say what a line of a failing run is: (kind, pattern over the trimmed line); the first match counts.
FAILURE_RULES = (
    ("root", r"(?i)^(?:x |stderr \| )"),
    ("hint", r"(?i)^(?:help:|hint:|note:)|did you mean|available fixtures|try using|suggestion"),
    ("stack", r"^(?:at |#|Traceback|File \")|(?i:stack traceback)"),
    ("root", r"FAIL|ERROR|(?i:^error |error:|panic|fatal|assert|exception|caused by|undefined reference|cannot |no such file|does not exist)"),
)
PASSING = r"(?i)^ok | passed"
FAILING = r"(?i)fail|error|panic|fatal|assert|exception|caused by|undefined reference|cannot |no such file|does not exist"
PROGRESS = (
    r"(?i)^(?:progress:|resolving:|downloading[ :]|fetching[ :]|extracting |linking dependencies|transforming \(|bundling |building modules|copying files)"
)
INSTALL = r"(?i)^(?:(?:added|removed|changed|audited) .* ?package|up to date|lockfile is up to date|already up to date|npm notice|npm fund|done in )|packages are looking for funding|found 0 vulnerabilities"


def failure_noise(line: Column) -> Column:
    """pass, progress or install for lines without signal, else empty."""
    t = F.lower(trim(line))
    boxed = t.startswith("[") & t.contains("/") & t.contains("]") & t.rlike("build|download|fetch|link")
    part = t.contains("%") & t.rlike("download|fetch|install|progress")
    return F.when(t.rlike(PASSING) & ~t.rlike(FAILING), "pass").when(t.rlike(PROGRESS) | boxed | part, "progress").when(t.rlike(INSTALL), "install").otherwise("")


def failure_kind(line: Column) -> Column:
    """root, hint, stack, warning or empty."""
    t = trim(line)
    out = F.lit("")
    rules = [(k, t.rlike(p)) for k, p in FAILURE_RULES] + [("stack", anchor(t) != ""), ("warning", F.lower(t).contains("warning"))]
    for kind, hit in reversed(rules):
        out = F.when(hit, kind).otherwise(out)
    return out


# Words and fragments that say what a log line is. Fixed values.
LOG_WORDS = {
    "error": "panic|fatal|error|failed|failure|exception|traceback|assertionerror",
    "hint": "warning|warn|hint|help|note",
    "boilerplate": "debug|info|trace|progress|downloading|downloaded|fetching|installing|installed|resolving|waiting|retrying|connected|heartbeat",
}
LOG_PARTS = {"error": "segmentation fault", "anchor": "^at |^#|caused by:", "boilerplate": "listening on|watching for changes"}


def log_kind(line: Column) -> Column:
    """4 error, 3 anchor, 2 hint, 1 boilerplate, 0 other: by the first three fields of a line and by fragments."""

    def of(low: Column) -> Column:
        parts = F.filter(F.transform(F.split(low, r"[ \t\[\](){}<>|=]+"), lambda x: F.regexp_replace(x, "^[:.,;!?\"'`*-]+|[:.,;!?\"'`*-]+$", "")), lambda x: x != "")

        def kind(fields: Column) -> Column:
            has = lambda k: F.exists(fields, lambda x: x.rlike(f"(?:{LOG_WORDS[k]})$"))
            return (
                F.when(low == "", 1).when(low.contains(LOG_PARTS["error"]) | has("error"), 4).when((anchor(line) != "") | low.rlike(LOG_PARTS["anchor"]), 3)
                .when(has("hint"), 2).when(low.rlike(LOG_PARTS["boilerplate"]) | has("boilerplate"), 1).otherwise(0)
            )

        return let(F.slice(parts, 1, 3), kind)

    return let(F.lower(trim(line)), of)
