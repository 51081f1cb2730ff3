import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from linelore.functions.paths import directory
from linelore.operators import sessions

SCHEMA = "seq long, timestamp timestamp_ntz, command string, cwd string, session_scope string, started string, n_records int"
T0 = datetime(2025, 9, 1)


def brute(data, gap=timedelta(minutes=30)):
    seen = {}
    for r in data:
        key = r[1:]
        seen[key] = min(seen.get(key, r[0]), r[0])
    groups = {}
    for (t, _, cwd, scope, *_), seq in ((k, v) for k, v in seen.items()):
        d = "/".join(x for x in (cwd or "").split("/") if x not in ("", "."))
        if t is not None and cwd:
            groups.setdefault((d, scope), []).append((t, seq))
    out = []
    for es in groups.values():
        es.sort()
        cur = []
        for e in es:
            if cur and e[0] - cur[-1][0] > gap:
                out.append((cur[0][1], cur[-1][1], len(cur)))
                cur = []
            cur.append(e)
        out.append((cur[0][1], cur[-1][1], len(cur)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width,reuse", [(1, "true"), (7, "false"), (64, "true"), (64, "false")])
def test_does_not_depend_on_reused_exchanges(spark, width, reuse):
    r = random.Random(9)
    data = [(i, T0 + timedelta(seconds=r.randrange(900_000)), "c", r.choice(["/hot", "/hot", "/a"]), r.choice(["s", None]), "", 1) for i in range(3000)]
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.exchange.reuse")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        got = sessions.work_sessions(spark.createDataFrame(data, SCHEMA))
        assert rows(got.select("first_seq", "last_seq", "n_records")) == brute(data)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_against_brute_force(spark):
    r = random.Random(4)
    data = []
    for i in range(900):
        hot = r.random() < 0.4
        cwd = "/hot" if hot else r.choice(["/a/b", "/a//b", "/a/b/", "/a/./b", "/c", "", None])
        t = None if r.random() < 0.03 else T0 + timedelta(minutes=r.randrange(4000), seconds=r.choice([0, 0, 30]))
        data.append((i, t, r.choice(["x", "y"]), cwd, None if hot else r.choice([None, "s1", "s2"]), r.choice(["clash", None]), r.choice([1, None])))
    data += [(1000 + k, *data[k][1:]) for k in range(0, 300, 3)]  # copies
    got = sessions.work_sessions(spark.createDataFrame(data, SCHEMA)).select("first_seq", "last_seq", "n_records")
    assert rows(got) == brute(data)


def test_gap_ties_and_empty(spark):
    data = [(5, T0, "x", "/d", None, None, 1), (3, T0, "y", "/d", None, None, 1), (9, T0 + timedelta(minutes=30), "x", "/d", None, None, 1), (7, T0 + timedelta(minutes=60, seconds=1), "x", "/d", None, None, 1)]
    got = sessions.work_sessions(spark.createDataFrame(data, SCHEMA)).select("first_seq", "last_seq", "n_records", "duration_ms")
    assert rows(got) == [(3, 9, 3, 1_800_000), (7, 7, 1, 0)]
    assert sessions.work_sessions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_directory(spark):
    cases = {"/a//b": "/a/b", "/a/./b/": "/a/b", "/a/b/.": "/a/b", "//": "/", "/": "/", "./a": "a", "": None, "/a/.b": "/a/.b", "/a/..": "/a/.."}
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", directory(F.col("c")).alias("d"))
    assert {r.c: r.d for r in df.collect()} == cases
