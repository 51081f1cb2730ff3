"""Runs of like events in ordered sequences, each collapsed into one event.

An event that matches the one before it points to it, any other event points to itself. Pointer doubling then replaces
each pointer by its target's pointer until all point to the start of their run: a run of n events takes about log2(n) self-joins.
The joins are on (sequence, position), so a sequence that holds a third of all events is spread over all tasks. Only
matching events and the starts of their runs enter the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelore.session import cut_lineage

MAX_ROUNDS = 40  # runs of up to 2^40 events

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
ANSI = r"\x1B(?:\[[0-?]*[ -/]*[@-~]|[\]PX^_][^\x07\x1B\n]*(?:\x07|\x1B\\)|[ -/]*[0-~])"
DATE_NAMES = rf"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? +(?={_MONTH}\b)|\b{_MONTH}(?= +\d|/\d)"
VARIABLE = (
    r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z_])(?=[a-f]*[0-9])[0-9a-f]{6,}(?![0-9A-Za-z_])"
    r"|[0-9]+(?:[.,:][0-9]+)*"
)


def line_key(text: Column) -> Column:
    """What must be equal for two lines to repeat one another; empty for a blank line. All lines of a text at once.

    Colour codes go, white space collapses, and numbers, hexadecimal words, UUIDs and the names of a timestamp's month and
    weekday become one sign each. Line ends stay where they are.
    """
    t = F.when(F.contains(text, F.lit("\x1b")), F.regexp_replace(text, ANSI, "")).otherwise(text)
    t = F.regexp_replace(F.regexp_replace(t, DATE_NAMES, ""), VARIABLE, "\u0001")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\x0B\f\r]+", " "), " ?\n ?", "\n"))


def text_events(texts: DataFrame, record_id: str, text: str) -> DataFrame:
    """``seq_id, pos, prev, same, line``: the lines of each text that aren't blank, linked to the one before.

    ``pos`` and ``prev`` are line numbers (from 1, blank lines counted). Null and empty texts have no events.
    """
    raw = F.col(f"`{text}`").cast("string")
    t = texts.select(F.col(f"`{record_id}`").cast("bigint").alias("seq_id"), F.split(raw, "\n").alias("ls"), F.split(line_key(raw), "\n").alias("ks")).where("seq_id is not null and ls is not null")
    keyed = F.zip_with("ls", "ks", lambda x, k: F.struct(k.alias("key"), x.alias("line")))
    numbered = F.transform(keyed, lambda x, i: F.struct((i + 1).cast("bigint").alias("pos"), x["key"].alias("key"), x["line"].alias("line")))
    t = t.select("seq_id", F.filter(numbered, lambda x: x["key"] != "").alias("es"))
    shifted = F.concat(F.array(F.lit(None).cast("struct<pos:bigint,key:string,line:string>")), F.slice("es", 1, F.greatest(F.size("es") - 1, F.lit(0))))
    t = t.select("seq_id", F.explode(F.arrays_zip(F.col("es").alias("e"), shifted.alias("p"))).alias("z")).select("seq_id", "z.e.*", F.col("z.p.pos").alias("prev"), F.col("z.p.key").alias("prev_key")).where("pos is not null")
    return t.select("seq_id", "pos", "prev", F.coalesce(F.col("key") == F.col("prev_key"), F.lit(False)).alias("same"), "line")


def run_starts(events: DataFrame) -> DataFrame:
    """``seq_id, pos, start``: of each event that is in a run of two or more, the position at which its run starts.

    ``events`` has ``seq_id, pos, prev`` (position of the event before) and ``same`` (whether it matches that one). Repeated
    events of one position count once. A pointer that has reached the start of its run is not looked up again.
    """
    members = events.where("same").groupBy("seq_id", "pos").agg(F.max("prev").alias("start"))
    open_, done = cut_lineage(members.withColumn("final", F.lit(False))), []
    for _ in range(MAX_ROUNDS):
        every = open_
        for d in done:
            every = every.unionByName(d)
        # the start of a run has no pointer: what points to it is done, and so is what points to one that is done
        up = every.select("seq_id", F.col("pos").alias("start"), F.col("start").alias("beyond"), F.col("final").alias("up_final"))
        nxt = cut_lineage(open_.select("seq_id", "pos", "start").join(up, ["seq_id", "start"], "left").select("seq_id", "pos", F.coalesce("beyond", "start").alias("start"), (F.col("beyond").isNull() | F.col("up_final")).alias("final")))
        done.append(nxt.where("final"))
        open_ = nxt.where("not final")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"runs of more than 2^{MAX_ROUNDS} events")
    ptr = done[0]
    for d in done[1:]:
        ptr = ptr.unionByName(d)
    ptr = ptr.select("seq_id", "pos", "start")
    first = ptr.select("seq_id", F.col("start").alias("pos"), "start").distinct()
    return ptr.unionByName(first)


def runs(events: DataFrame, at_least: int = 2) -> DataFrame:
    """``seq_id, first, last, n``: the maximal runs of at least so many like events."""
    s = run_starts(events).groupBy("seq_id", "start").agg(F.max("pos").alias("last"), F.count("*").alias("n"))
    return s.where(F.col("n") >= at_least).select("seq_id", F.col("start").alias("first"), "last", "n")


def clock_ms(line: Column) -> Column:
    """Milliseconds within the day of the first clock time in a line, null for none."""
    p = r"(?<!\d)([01]\d|2[0-3]):([0-5]\d):([0-5]\d)(?:[.,](\d{1,3}))?"
    g = lambda i: F.regexp_extract(line, p, i)
    return F.when(line.rlike(p), ((g(1).cast("int") * 60 + g(2).cast("int")) * 60 + g(3).cast("int")) * 1000 + F.coalesce(F.rpad(g(4), 3, "0").try_cast("int"), F.lit(0)))


def collapsed(texts: DataFrame, record_id: str, text: str, at_least: int = 2) -> DataFrame:
    """``seq_id, first_line, last_line, n, duration_ms, line``: every line that isn't blank, runs collapsed to their first line.

    ``duration_ms`` is the time between the clock times of the first and the last line (over midnight too), null without any.
    An id names one text; rows that repeat it count once.
    """
    e = cut_lineage(text_events(texts, record_id, text))  # read twice: for the pointers, and for the lines
    s = run_starts(e)
    if at_least > 2:
        s = s.join(s.groupBy("seq_id", "start").agg(F.count("*").alias("size")).where(F.col("size") >= at_least), ["seq_id", "start"], "left_semi")
    lines = e.select("seq_id", "pos", "line", clock_ms(F.col("line")).alias("clock")).join(s, ["seq_id", "pos"], "left")
    g = lines.groupBy("seq_id", F.coalesce("start", "pos").alias("first_line")).agg(
        F.max("pos").alias("last_line"), (F.count("*") / F.count_if(F.col("pos") == F.coalesce("start", "pos"))).cast("bigint").alias("n"), F.min_by("line", "pos").alias("line"), (F.max_by("clock", "pos") - F.min_by("clock", "pos")).alias("spent")
    )
    spent = F.when(F.col("n") > 1, F.pmod("spent", F.lit(86_400_000)).cast("bigint"))
    return g.select("seq_id", "first_line", "last_line", "n", spent.alias("duration_ms"), "line")


def found_runs(captures: DataFrame) -> DataFrame:
    """``capture_id, first_line, last_line`` of runs of at least three lines."""
    r = runs(text_events(captures, "capture_id", "raw_combined"), 3)
    return r.select(F.col("seq_id").alias("capture_id"), F.col("first").alias("first_line"), F.col("last").alias("last_line"))
