import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from linelore.functions import text as T
from linelore.functions.fingerprint import fingerprint, fingerprint_value
from linelore.functions.tokens import estimate, hard_cap
from linelore.operators import domain, lines, render, route


def test_tokens(spark):
    r = random.Random(1)
    texts = ["", " ", "a", "internationalisation of configuration", "a.b.c!!", "é漢字 x", "\x0b\t"] + ["".join(r.choice("ab 1.,\n-é") for _ in range(r.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.estimate_tokens(F.col("t")).alias("n"))
    for row in df.collect():
        assert row.n == estimate(row.t), row.t


def test_similar_key(spark):
    cases = {
        "2024-01-02T10:00:00.123Z ERROR boom 42": "ERROR boom",
        "ERROR 2024-01-02T10:00:00Z boom": "ERROR boom",
        "INFO  12:00:01 step (3/10)": "INFO step",
        "Jan  2 15:04:05 host msg": "host msg",
        "[12:00:01] x 12ms": "x",
        "1712345678 done": "done",
        "12:00:01": "12:00:01",
        "": "",
        "plain   text": "plain text",
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", T.similar_line_key(F.col("l")).alias("k"))
    assert {r.l: r.k for r in df.collect()} == cases


def test_lines_and_kinds(spark):
    df = spark.createDataFrame([("src/app/main.go:12:3: undefined: x",), ("FAIL x",), ("hint: try",), ("at foo (a.js:1)",), ("warning: y",), ("ok  pkg 0.1s",), ("Downloading z",), ("npm notice new",)], "l string")
    got = {r.l: (r.k, r.n, r.a) for r in df.select("l", T.failure_kind(F.col("l")).alias("k"), T.failure_noise(F.col("l")).alias("n"), T.anchor(F.col("l")).alias("a")).collect()}
    assert got["src/app/main.go:12:3: undefined: x"] == ("stack", "", "src/app/main.go:12:3:")
    assert got["FAIL x"][0] == "root" and got["hint: try"][0] == "hint" and got["at foo (a.js:1)"][0] == "stack" and got["warning: y"][0] == "warning"
    assert (got["ok  pkg 0.1s"][1], got["Downloading z"][1], got["npm notice new"][1]) == ("pass", "progress", "install")


def test_specs(spark):
    df = spark.createDataFrame([(1, "a\r\na\n\nb 1\nb 2\nc"), (2, ""), (3, None), (4, "x\n" * 30)], "id int, text string")
    got = {r.id: (r.rendered, r.total_lines, r.omitted) for r in lines.apply_spec(df, lines.BUILTIN["compact_lines"]).collect()}
    assert got[1] == ("a (x2)\nb 1 (x2)\nc", 3, 0) and got[4] == ("x (x30)", 1, 0)
    assert got[2][0] == "" and got[3][0] is None
    ends = {r.id: r.rendered for r in lines.apply_spec(df, lines.Spec("e", head=1, tail=1)).collect()}
    assert ends[4] == "x\n... +28 more lines\nx"
    with pytest.raises(ValueError):
        lines.Spec.from_dict({"name": "x", "colour": 1})
    assert lines.Spec("t", tail=5).limited(3).tail == 3


def test_fingerprint(spark):
    cs = ["git status", " Git\t STATUS\n", "", None, "é ü", "x" * 2000]
    got = {r.c: r.f for r in spark.createDataFrame([(c,) for c in cs], "c string").select("c", fingerprint(F.col("c")).alias("f")).collect()}
    assert got == {c: fingerprint_value(c) for c in cs} and got["git status"] == got[" Git\t STATUS\n"] == "f1fad301d14b9093"


def test_fit_priority_lines(spark):
    def plain(c, ml, tb):
        kept, rem = [], tb
        for tier, pos, cost in sorted(c):
            if ml and len(kept) >= ml:
                break
            if tb and cost > rem and kept and tier > 0:
                continue
            kept.append(pos)
            rem -= cost
        return sorted(kept)

    r = random.Random(3)
    data = [(i, [(r.randrange(4), p, r.randrange(1, 40)) for p in range(r.randrange(12))]) for i in range(60)]
    df = spark.createDataFrame(data, "id int, c array<struct<tier:int,pos:int,cost:int>>")
    for ml, tb in ((0, 0), (3, 0), (0, 60), (8, 50)):
        got = {x.id: x.k for x in df.select("id", render.fit_priority_lines(F.col("c"), ml, tb).alias("k")).collect()}
        assert got == {i: plain(c, ml, tb) for i, c in data}


def test_render(spark):
    noisy = "\n".join(f"step {i} of the build took a while and said many words" for i in range(200)) + "\nerror: src/x.go:17: broken E1234\n"
    df = spark.createDataFrame([(1, noisy, 1, "go-build"), (2, "ok", 0, "ls"), (3, None, 0, None), (4, "", 1, "x")], "id int, t string, exit_code int, p string")
    got = {r.id: r for r in render.render(df, "t", "exit_code", "p").collect()}
    assert got[1].filtered_tokens <= got[1].raw_tokens / 5 + 40 and "x.go:17" in got[1].rendered and got[1].missing == []
    assert got[2].rendered == "ok" and got[3].rendered == "" and got[4].rendered == ""
    assert estimate(hard_cap(noisy, 64)) <= 64 and hard_cap("word " * 500, 20)


def test_routes(spark):
    cases = {"git status": "git-status", "env A=1 time cargo test -p x": "cargo-test", "pnpm --filter a test": "js-package-test", "npm run lint": "js-workspace", "gh pr checks 5": "gh-pr-checks", "make all": "generic-summary", "docker ps": "docker-ps", "": "generic-summary"}
    df = spark.createDataFrame([(k, k.split()) for k in cases], "c string, w array<string>").select("c", route.profile(F.col("w")).alias("p"))
    assert {r.c: r.p for r in df.collect()} == cases


def test_tools(spark):
    mk = lambda t: domain.tool_lines(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t")
    assert rows(domain.status_counts(mk("## main...origin/main\nM  a\n M b\n?? c\n"))) == [(1, 1, 1, 1, "main...origin/main")]
    assert rows(domain.commits(mk("abcdef1 fix\nabcdef2 fix\nabcdef3 (HEAD) add"))) == [(1, 1, "fix", 2), (1, 3, "add", 1)]
    assert rows(domain.check_rows(mk("build\tpending\t1m\nbuild\tpass\t2m\nlint\tfail\t"))) == [(1, "build", "pass", 1, 1), (1, "lint", "fail", 0, 3)]
    assert rows(domain.containers(mk("a img Up 3 hours\nb img Exited (1) 2 days ago\n"))) == [(1, 1, 1, 0)]
    assert rows(domain.applied(mk("pod/a created\npod/b created\nsvc/c unchanged"))) == [(1, "created", 2, ["pod/a", "pod/b"]), (1, "unchanged", 1, ["svc/c"])]
    assert rows(domain.images(mk("repo latest 0123456789ab 2 days ago 1.5GB\n<none> <none> 0123456789ac 3 days ago 100MB"))) == [(1, 2, 1, 1600.0)]
    env = {r.prefix: r.names for r in domain.environment(mk("AWS_KEY=abc\nAWS_REGION=eu\nHOME=/root")).collect()}
    assert env["AWS"] == ["AWS_KEY=<redacted len=3>", "AWS_REGION=eu"]
    ev = '{"Action":"fail","Package":"p","Test":"TestA"}\n{"Action":"fail","Package":"p"}\n{"Action":"pass","Package":"q"}'
    assert rows(domain.test_events(mk(ev))) == [(1, "p", "fail", ["TestA"]), (1, "q", "pass", [])]
