import json

from conftest import rows
from pyspark.sql import functions as F

from linelore.functions import text as T
from linelore.functions.tokens import cap_words, estimate, hard_cap, ultra_compact
from linelore.operators import reduce, render, route
from linelore.plans.fixtures import SCHEMA, fixtures
from linelore.reducers import base, structured, tools


def test_fixtures_meet_their_gates(spark):
    got = render.measure(spark.createDataFrame(fixtures(), SCHEMA)).collect()
    assert len(got) == 36
    assert [r for r in got if not r.ok] == []


def test_python_and_columns_agree(spark):
    lines = ["2025-09-01T10:00:00.123Z ERROR disk full 17", "Sep  2 10:00:00 host ok (3/7)", "[WARN] 10:00:01 slow 12ms", "1756736046 INFO x", "ERROR", "", "plain line", "2025-09-01 10:00:00 FATAL boom", "at a.go:1: b.py:2: c", "x [eval]:3 y", "level=warn msg", "deadbeef01 took 10:11"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    for r in df.select("t", T.similar_line_key(F.col("t")).alias("k"), T.severity(F.col("t")).alias("s"), T.anchor(F.col("t")).alias("a"), T.template_key(F.col("t")).alias("m")).collect():
        assert (base.similar_key(r.t), base.severity(r.t), base.anchor(r.t), structured.template(r.t)) == (r.k, r.s, r.a, r.m)


def test_json_family(spark):
    v = {"zeta": [1, 2, 3, 4], "id": "a", "status": {"state": "ok", "deep": {"x": {"y": {"z": 1}}}}}
    assert structured.structure(v) == ["{", "  id: string", "  status: {", "    state: string", "    deep: {", "      x: {", "        y: {... 1 keys}", "      }", "    }", "  }", "  zeta: [", "    number", "    ... +3 more items", "  ]", "}"]
    assert structured.preview(v, 3) == ["root: object keys=3", "root.id=a", "root.status: object keys=2", "... more values"]
    items = [{"id": i, "kind": "odd" if i == 17 else "even", "v": "x" * 80} for i in range(30)] + ["loose"]
    t = structured.uniform_table(items, 8)
    assert t[0] == "array len=31 uniform objects, cols: id|kind|v" and t[-1] == "... +25 more rows"
    assert t[1].startswith("0|even|") and "#17 17|odd|" + "x" * 64 + "..." in t and "#30 loose" in t and len(t) == 8
    assert structured.uniform_table(items[:4]) is None and structured.uniform_table([{"a": 1}] * 9) is None
    nd = "\n".join(json.dumps(x) for x in items[:6])
    df = spark.createDataFrame([(1, json.dumps(items)), (2, "{bad"), (3, None), (4, json.dumps(v))], "id int, t string")
    got = {r.id: r.table for r in reduce.json_table(df, "t", 8).collect()}
    assert got[1].split("\n") == t and got[2] is None and got[3] is None and got[4].startswith("root: object")
    assert tools.reduced(nd, "json-query").startswith("stream len=6")


def test_priority_fit():
    cands = [(1, "a" * 40), (0, "FAIL " + "b" * 400), (2, "c"), (1, "d" * 400)]
    assert base.fit(cands, 3, 40) == ([cands[1][1]], 3)  # tier 0 stays whatever it costs, and has spent the budget
    assert base.fit(cands[:1] + cands[2:], 3, 15) == ([cands[0][1], "c"], 1)  # what doesn't fit is passed over
    assert base.fit(cands, 0, 0)[1] == 0 and base.fit([], 3, 3) == ([], 0)


def test_reducers_take_anything():
    odd = ["", "\n\n", "\x1b[31m", "{", "[]", "{}", "null", "a\tb\n" * 50, "x" * 20_000, "(((((\n" * 3, '{"items": [1, null, {"status": null}]}', "=" * 90, "日本語\nerror: x", "@@ -1 +1 @@", "diff --git a/x b/y"]
    for profile in [*tools.REDUCERS, "passthrough", "unknown", None]:
        for text in odd:
            for code in (0, 1):
                assert isinstance(tools.reduced(text, profile, code), str)
    assert tools.reduced(None, "git-log") == ""


def test_hard_cap_is_exact():
    text = "\n".join(f"line {i} of foo_{i}.py:{i} error" if i % 7 == 0 else f"note {i} , ; - plain words and more" for i in range(400))
    for most in (20, 64, 333):
        out = hard_cap(text, most)
        assert 0 < estimate(out) <= most and "error" in out and "..." in out
    assert estimate(cap_words("word " * 5000, 20)) <= 20
    assert hard_cap("a\nb", 100) == "a\nb"
    assert ultra_compact("one", False) == "one" and " | " in ultra_compact(text, True) and "+" in ultra_compact(text, True)


def test_changes_count_one_for_one(spark):
    assert render.changed_lines("a\na\nb\n", "a\nb\nb\nc\n") == (["b", "c"], ["a"])
    big = "\n".join(f"row {i}" for i in range(60))
    d = render.digest(big, big + "\nERROR new failure\nplain", big, 120, "abc")
    assert d.split("\n") == ["since last run (2m ago): +2 -0 lines [baseline: abc]", "+ERROR new failure", "+plain"]
    assert render.digest("x", "y", "short", 1, "abc") is None
    df = spark.createDataFrame([(1, "first\n" + "row text\n" * 60, "abc", 61, 2, False), (2, "ok", "abc", 1, 2, False), (3, "x\n" * 99 + "FAIL a\nERROR b", "abc", 1, 3, True)], "id int, r string, ref string, s int, n int, bad boolean")
    got = {r.id: r.reference for r in render.reference_render(df, "r", "ref", "s", "n", F.col("bad")).collect()}
    assert got[1] == "first\nunchanged from previous run (1m ago, x2 identical) [ref: abc]" and got[2] is None and got[3].startswith("FAIL a\nERROR b\nunchanged")


def test_session_renders(spark):
    import datetime

    t = datetime.datetime(2025, 9, 1)
    long = "\n".join(f"src/{i}.go:{i}: undefined: name{i} in file" for i in range(80))
    runs = [(1, t, "f", "/w", 1, "go-build", long), (2, t + datetime.timedelta(minutes=5), "f", "/w", 1, "go-build", long), (3, t + datetime.timedelta(minutes=9), "f", "/w", 1, "go-build", long + "\nsrc/new.go:7: undefined: x"), (4, t + datetime.timedelta(hours=9), "f", "/w", 1, "go-build", long)]
    df = spark.createDataFrame(runs, "id int, ts timestamp_ntz, fingerprint string, cwd string, exit_code int, profile string, text string")
    got = {r.id: (r.kind, r.shown) for r in render.session_renders(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "whole", 2: "reference", 3: "digest", 4: "whole"}
    assert "+src/new.go:7: undefined: x" in got[3][1]


def test_adapters(spark):
    s = spark.createDataFrame([("f", "p", "tighten", "noisy", "high", 30, 4, 200, 30), ("g", "p", "loosen", "fallback_heavy", "high", 30, 40, 9000, 900), ("h", "other", "loosen", "noisy", "high", 30, 40, 9000, 900), ("low", "p", "loosen", "x", "low", 30, 40, 9000, 900)], "fingerprint string, profile string, direction string, reason string, confidence string, samples int, max_lines int, max_bytes int, max_tokens int")
    r = spark.createDataFrame([(k, "p", 12) for k in ("f", "g", "h", "low", "none")], "fingerprint string, profile string, budget_lines int")
    got = {x.fingerprint: (x.adapted_lines, x.adapted_bytes, x.adapted_tokens, x.adaptation) for x in render.adapt_budgets(r, s).collect()}
    assert got == {"f": (10, 1536, 308, "tighten"), "g": (21, 3360, 672, "loosen"), "h": (12, 1920, 384, None), "low": (12, 1920, 384, None), "none": (12, 1920, 384, None)}
    gate = {x.fingerprint: x.adapted_lines for x in render.adapt_budgets(r, s, 10, 15, False, None, 20).collect()}
    assert gate == {"f": 11, "g": 14, "h": 12, "low": 14, "none": 12}


def test_shell_words_and_rules(spark):
    cases = {"bash -c 'git  status --short'": ["git", "status", "--short"], 'grep "a b" x\\ y': ["grep", "a b", "x y"], "": [], "env A='1 2' npx jest": ["env", "A=1 2", "npx", "jest"]}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.w for r in df.select("c", route.shell_words(F.col("c")).alias("w")).collect()} == cases
    got = {r.command: (r.words, r.profile) for r in route.explain(df, "c").collect()}
    assert got["bash -c 'git  status --short'"][1] == "git-status" and got["env A='1 2' npx jest"] == ("jest", "jest-json")
    rules = [{"profile": "mine", "prefix": ["make"], "exclude": ["clean"], "cwd_contains": "/srv"}]
    d = spark.createDataFrame([(["make", "all"], "/srv/x"), (["make", "clean"], "/srv/x"), (["make"], None)], "w array<string>, d string")
    assert [r.profile for r in route.rule_profiles(d, F.col("w"), F.col("d"), rules, F.lit("generic-summary")).collect()] == ["mine", "generic-summary", "generic-summary"]


def test_recovery(spark):
    df = spark.createDataFrame([("a\n", 3, "p"), ("a", 0, "p"), ("a", 3, None), ("", 2, "p")], "r string, n int, p string")
    assert [x.r for x in render.with_recovery(df, "r", F.col("n"), "p").collect()] == ["a\n[recovery: 3 more lines; full output: p]", "a", "a", "[recovery: 2 more lines; full output: p]"]


def test_by_content_and_command(spark):
    df = spark.createDataFrame([("10:00:00 INFO a 1\n" * 9, "git log", 0), (None, None, None)], "t string, c string, e int")
    assert reduce.reduce_by_content(df, "t").first().reduced.startswith("9 lines: 9 INFO")
    got = reduce.reduce_commands(df, "t", "c", "e").collect()
    assert got[0].profile == "git-log" and got[1].reduced == ""
    assert rows(reduce.json_structure(df, "c").select("structure")) == [(None,), (None,)]
