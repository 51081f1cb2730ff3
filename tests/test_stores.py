import json
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from linelore.operators import dedup, history, logs, search, tables, workflow
from linelore.functions import text as T
from linelore.sources import jsonl, stores
from linelore.streaming import streams

T0 = datetime(2025, 9, 1)


def test_totals(spark, tmp_path):
    h = spark.read.parquet("/root/testdata/sf0.001/history.parquet")
    a, b = history.fold_totals(h.where("seq % 2 = 0")), history.fold_totals(h.where("seq % 2 = 1"))
    stores.write_totals(a, str(tmp_path / "t"))
    both = history.combine_totals(stores.read_totals(spark, str(tmp_path / "t")), b).first()
    whole = history.combine_totals(history.fold_totals(h)).first()
    assert both.commands == whole.commands and abs(both.savings_pct_sum - whole.savings_pct_sum) < 1e-6
    # the tool's own removal is known by its names, other tools' is not
    c = spark.createDataFrame([("mytool uninstall x",), ("npm uninstall x",), ("Uninstall",), ("",)], "c string")
    assert [r[0] for r in c.select(history.excluded_command(F.col("c"), ["mytool"])).collect()] == [True, False, True, False]


def test_counted_percentiles(spark):
    data = [("a", i) for i in range(1000)] + [("a", 10**7), (None, 5), (None, 10**9), ("one", 7)] + [("neg", -3), ("neg", -70_000), ("neg", 4)]
    df = spark.createDataFrame(data, "g string, v long")
    got = {r.g: (r.lo, r.hi) for r in history.with_percentiles(df, ["g"], "v", {"lo": 0.5, "hi": 0.95}).collect()}
    assert got == {"a": (500, 950), None: (5, 10**9), "one": (7, 7), "neg": (-3, 4)}


def test_dedup_index(spark, tmp_path):
    e = spark.createDataFrame([(T0 + timedelta(minutes=i), f"{i:064x}", "h", f"/a/{i}", "ls", "f", "/w", 0, 10, False, "") for i in range(30)], stores.DEDUP_ENTRY)
    stores.append_entries(e, str(tmp_path / "i"))
    (tmp_path / "i" / "bad.json").write_text("{oops\n")
    got = stores.dedup_index(spark, str(tmp_path / "i"))
    assert got.count() == 30
    kept = stores.compacted(got, 10, 100_000)
    assert sorted(int(r.raw_hash, 16) for r in kept.collect()) == list(range(20, 30))
    assert 0 < stores.compacted(got, 10, 900).count() < 10
    art = spark.createDataFrame([("/a/7", bytearray(b"x"))], "path string, data binary")
    ref = dedup.expand(got.withColumn("ts", F.col("timestamp")), art, f"{7:064x}"[:64])
    assert rows(ref.select("path", "ok")) == [("/a/7", False)]


def test_events_and_outbox(spark, tmp_path):
    e = spark.createDataFrame([(T0, "render", "x"), (T0 + timedelta(days=1), "cap", "y")], stores.EVENT)
    stores.append_events(e, str(tmp_path / "e"))
    assert stores.read_events(spark, str(tmp_path / "e"), F.lit("2025-09-01 12:00:00").cast("timestamp")).count() == 1
    q = stores.outbox(streams.tail_json(spark, str(tmp_path / "e"), stores.EVENT), str(tmp_path / "out"), str(tmp_path / "ck"), 1)
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_rules_and_find(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"profile": "p", "prefix": ["make"]}, {"profile": "all"}, {"profile": "q", "nope": 1}]))
    (tmp_path / "b.json").write_text("{bad")
    (tmp_path / "c.json").write_text(json.dumps({"profile": "p", "prefix": ["ninja"]}))
    rules, warnings = stores.load_rules(str(tmp_path))
    assert rules == [{"profile": "p", "prefix": ["ninja"]}] and len(warnings) == 3
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "d.json").write_text("{}")
    names = lambda **k: sorted(r.name for r in stores.find(spark, str(tmp_path), "*.json", **k).collect())
    assert names() == ["a.json", "b.json", "c.json", "d.json"] and names(exclude=["node_modules"]) == ["a.json", "b.json", "c.json"] == names(max_depth=1)
    p = stores.piped(spark, str(tmp_path / "b.json")).first()
    assert p.text == "{bad" and p.omitted == 0
    idx = spark.createDataFrame([("a", T0, 1), ("b", T0 + timedelta(1), 1)], "id string, timestamp timestamp, n int")
    assert stores.latest(idx).first().id == "b"
    assert rows(stores.replaced(idx, idx.where("id = 'a'").withColumn("n", F.lit(9))).select("id", "n")) == [("a", 9), ("b", 1)]


def test_clipping(spark, tmp_path):
    long = "é" * 6000
    df = spark.createDataFrame([(long,), ("short",), (None,), ("🧪" * 3000,)], "c string").select(jsonl.clip_bytes(F.col("c"), 8191).alias("c"))
    got = [r.c for r in df.collect()]
    assert got == [long[:4095], "short", None, "🧪" * 2047]
    (tmp_path / "h.jsonl").write_text(json.dumps({"command": "x" * 9000}) + "\n" + json.dumps({"command": "y"}) + "\n")
    recs, counts = jsonl.read_records(spark, str(tmp_path / "h.jsonl"))
    assert dict(rows(counts)) == {"ok": 1, "repaired": 1} and max(len(r.command) for r in recs.collect()) == 8192


def test_chunks(spark, tmp_path):
    whole = "one\ntwo \x1b[31mred\x1b[0m\r\n\nlast"
    cuts = [0, 2, 5, 9, 12, 13, 20, len(whole)]
    data = [("s", i, whole[a:b], i == len(cuts) - 2) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    spark.createDataFrame(data, "stream string, seq long, chunk string, end boolean").write.parquet(str(tmp_path / "c"))
    s = streams.lines_of_chunks(spark.readStream.schema("stream string, seq long, chunk string, end boolean").parquet(str(tmp_path / "c")))
    q = s.writeStream.format("memory").queryName("chunks").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [r.line for r in spark.table("chunks").orderBy("line_no").collect()] == ["one", "two \x1b[31mred\x1b[0m", "", "last"]


def test_stream_of_outputs(spark, tmp_path):
    spark.createDataFrame([("10:00:00 INFO a 1\n" * 9, "generic-summary", 0)], "t string, p string, e int").write.parquet(str(tmp_path / "i"))
    q = streams.reduced_batches(spark.readStream.schema("t string, p string, e int").parquet(str(tmp_path / "i")), "t", "p", "e", str(tmp_path / "o"), str(tmp_path / "k"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "o")).first().reduced.startswith("9 lines")


def test_tree(spark):
    df = spark.createDataFrame([("a/b/c/x.go",), ("a/b/c/y.go",), ("./d/e",), ("d//f/g/h",), (None,), ("",)], "p string")
    t = search.tree(df, "p")
    assert [r.label for r in t.orderBy("dir").collect()] == ["  a/b/c/", "    x.go", "    y.go", "  d", "    e", "    f/g/", "      h"]
    got = [r.line for r in search.rendered_tree(t, "root", 4).orderBy("line_no").collect()]
    assert got[0] == "root" and got[-1].startswith("... +") and len(got) == 5


def test_small_functions(spark):
    df = spark.createDataFrame([("/a/b/c/d", 2048, "API_KEY", "xyz", "/home/u/p.q")], "p string, n long, k string, v string, d string")
    r = df.select(T.shorten_path(F.col("p")).alias("s"), T.humanize_bytes(F.col("n")).alias("h"), T.redact(F.col("k"), F.col("v")).alias("r"), T.project_directory(F.col("d")).alias("d"), tables.sql_line_kind(F.lit("(3 rows)")).alias("q")).first()
    assert tuple(r) == (".../b/c/d", "2.0KB", "<redacted len=3>", "-home-u-p-q", "summary")
    d = spark.createDataFrame([(1, "diff --git a/x b/x\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/y b/y\n@@ -1 +1 @@\n+c")], "id int, t string")
    assert rows(search.file_diffs(d, "id", "t")) == [(1, "x", 1, 1, 1), (1, "y", 1, 1, 0)]
    e = spark.createDataFrame([("a", "took 5 ms"), ("a", "took 7 ms")], "component string, message string")
    assert rows(logs.source_messages(e)) == [("a", "took N ms", 2)]
    k = spark.createDataFrame([("segmentation fault",), ("at x",), ("caused by: y",), ("INFO ok",), ("waiting for x",), ("WARN x",), ("plain",)], "t string").select(T.log_kind(F.col("t")).alias("k"))
    assert [r.k for r in k.collect()] == [4, 3, 3, 1, 1, 2, 0]
    assert rows(spark.createDataFrame([("kubectl get x",), ("zzz",)], "c string").select(workflow.family(F.col("c")))) == [("kubernetes",), ("other",)]
