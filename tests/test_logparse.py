from datetime import datetime, timezone

from conftest import rows

from linelore.operators import logparse

UNTIL = datetime(2025, 9, 2, 12, 0, 0)


def ms(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)


CASES = [
    ("2025-09-01T11:56:30.587Z WARN  [cronlet] user action accepted", ms(2025, 9, 1, 11, 56, 30) + 587, "WARN", "cronlet"),
    ("11:56:15.168 |-WARN in shardmap - token bucket is empty", ms(2025, 9, 2, 11, 56, 15) + 168, "WARN", "shardmap"),
    ("13:00:00.000 |-INFO in shardmap - warn threshold raised", ms(2025, 9, 1, 13), "INFO", "shardmap"),
    ("1756736046.695 vault_proxy INFO elected error as leader", ms(2025, 9, 1, 14, 14, 6) + 695, "INFO", "vault_proxy"),
    ("E0901 17:49:30.044803   21412 tile.render.go:189] flushed", ms(2025, 9, 1, 17, 49, 30) + 44, "ERROR", "tile.render"),
    ('{"level": 30, "time": 1756844841792, "name": "ledger-sync", "msg": "peer left"}', 1756844841792, "INFO", "ledger-sync"),
    ('{"ts": "2025-09-01T19:56:37.975Z", "logger": "batch_load", "lvl": "warn", "message": "x", "pid": 3}', ms(2025, 9, 1, 19, 56, 37) + 975, "WARN", "batch_load"),
    ('time=2025-09-01T20:58:24+05:30 level=debug component=cronlet msg="error in x"', ms(2025, 9, 1, 15, 28, 24), "DEBUG", "cronlet"),
    ("[Mon Sep 01 18:02:45.612807 2025] [mail_out:notice] [pid 9216] config reloaded", ms(2025, 9, 1, 18, 2, 45) + 612, "INFO", "mail_out"),
    ("2025-09-01 13:19:28,063 - queue_mux - CRITICAL - token bucket", ms(2025, 9, 1, 13, 19, 28) + 63, "FATAL", "queue_mux"),
    ("Sep  1 02:44:06 node-5 snapshotter[20536]: <err> timeout", ms(2025, 9, 1, 2, 44, 6), "ERROR", "snapshotter"),
    ("Sep 10 02:44:06 node-5 snapshotter[20536]: <info> timeout", ms(2024, 9, 10, 2, 44, 6), "INFO", "snapshotter"),
    ("02/Sep/2025:05:05:58 -0700 indexd/SEVERE: heartbeat from worker-70", ms(2025, 9, 2, 12, 5, 58), "ERROR", "indexd"),
]


def test_layouts(spark):
    data = [(i, c[0] if i % 2 else "web-1  | \x1b[2m" + c[0] + "\x1b[0m\r", UNTIL, "x") for i, c in enumerate(CASES)]
    # enough of each layout to be mined, and once alone for the fallback rules
    many = data + [(100 + 10 * k + i, d[1], UNTIL, "x") for k in range(1, 40) for i, d in enumerate(data[:10])]
    for table in (data, many):
        df = spark.createDataFrame(table, "id long, t string, u timestamp_ntz, level string")
        got = logparse.parse_entries(df, "id", "t", "u").where("record_id < 100").select("record_id", "ts_ms", "level", "component")
        assert rows(got) == sorted(((i, *c[1:]) for i, c in enumerate(CASES)), key=repr)


def test_entries_span_lines(spark):
    text = "$ tail x\n" + CASES[0][0] + "\nTraceback:\n  last success at 2025-08-25 03:54:00 on rami\n\n" + CASES[1][0] + "\n\n"
    df = spark.createDataFrame([(1, text, UNTIL), (2, None, UNTIL), (3, "", UNTIL), (4, "no entry here", None), (5, CASES[1][0], None), (6, "x" * 300_000 + "\n" + CASES[0][0], UNTIL)], "id long, t string, u timestamp_ntz")
    got = logparse.parse_entries(df, "id", "t", "u").select("record_id", "first_line", "last_line")
    assert rows(got) == [(1, 2, 4), (1, 6, 6), (6, 2, 2)]
    assert logparse.parse_entries(df.where("false"), "id", "t", "u").count() == 0


def test_stamps(spark):
    cases = {"2025-09-04T10:13:28.572738232Z": ms(2025, 9, 4, 10, 13, 28) + 572, "2025-09-09T22:38:11.826+05:30": ms(2025, 9, 9, 17, 8, 11) + 826, "2025-09-16 18:50:07.3": ms(2025, 9, 16, 18, 50, 7) + 300, "2025/09/26 11:29:45 UTC": ms(2025, 9, 26, 11, 29, 45), "1758048105": 1758048105000, "1758713700819": 1758713700819, "n/a": None, "": None, None: None, "2025-09": None, "202": None, "2025-13-45T00:00:00Z": None}
    df = spark.createDataFrame([(k,) for k in cases], "timestamp string")
    assert {r.timestamp: r.ts_ms for r in logparse.stamp_ms(df).collect()} == cases


def _entries(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, UNTIL) for i, t in enumerate(texts)], "id long, t string, u timestamp_ntz")
    return logparse.parse_entries(df, "id", "t", "u", **kw)


def test_templates_decide(spark):
    """A word that spells a level but never changes is a constant: the template finds the slot behind it, the fallback rules don't."""
    levels = ["WARN", "ERROR", "INFO"]
    lines = [f"2025-09-01T10:00:{i % 60:02} info desk {['north', 'south'][i % 2]} says {levels[i % 3]} from unit {i}" for i in range(120)]
    got = {r.record_id: r.level for r in _entries(spark, lines).collect()}
    assert got == {i: levels[i % 3] for i in range(120)}
    # without templates every such line would be read by the fallback rules
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1]), pa.array(["\n".join(lines)]), pa.array([0])], names=["a", "b", "c"])
    bare = [r["level"] for b in logparse._assign({}, False)(iter([batch])) for r in b.to_pylist()]
    assert bare == ["INFO"] * 120


def test_headers_of_any_length(spark):
    """Neither the moment nor the level nor the component has to stand near the line's begin."""
    far = [f"{' '.join(f'k{j}={j}' for j in range(30))} time=2025-09-01T10:00:00Z {' '.join(f'x{j}={j}' for j in range(30))} level={['info', 'error'][i % 2]} thread={i} pool=p component=cron_{i % 3} msg=x" for i in range(60)]
    got = {r.record_id: (r.level, r.component) for r in _entries(spark, far).collect()}
    assert got == {i: (["INFO", "ERROR"][i % 2], f"cron_{i % 3}") for i in range(60)}
    one = _entries(spark, far[:1]).collect()[0]  # an outlier
    assert (one.level, one.component) == ("INFO", "cron_0")
    label = "web" + "x" * 80 + "-12 | 2025-09-01T10:00:00Z WARN [cron] said"
    assert [(r.level, r.component) for r in _entries(spark, [label]).collect()] == [("WARN", "cron")]


def test_a_level_in_the_message_is_no_header(spark):
    lines = [f"[10:00:{i % 60:02}] socket of peer {i} closed after some error in read" for i in range(40)]
    assert _entries(spark, lines[:3]).count() == 0
    assert _entries(spark, lines).count() == 0
