import json
from datetime import datetime, timedelta

from conftest import rows

from linelore.operators import dedup, usage
from linelore.sources import artifacts, jsonl
from linelore.streaming import streams


def test_records(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    p.write_text('{"command":"ls","exit_code":1}\n\n{bad\n[1]\n{"command":"' + "x" * 20 + '"}\n')
    recs, counts = jsonl.read_records(spark, str(p))
    assert {r.command for r in recs.collect()} == {"ls", "x" * 20}
    assert dict(rows(counts)) == {"ok": 2, "corrupt": 2, "blank": 1}
    jsonl.append_records(recs.select("command"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_tool_pairs(spark, tmp_path):
    use = lambda i, c: json.dumps({"type": "assistant", "message": {"content": [{"type": "tool_use", "id": i, "name": "sh", "input": {"command": c}}]}})
    res = lambda i, t: json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": t}]}})
    d = tmp_path / "proj"
    d.mkdir()
    (d / "s.jsonl").write_text("\n".join([res("a", "early"), use("a", "one"), use("a", "two"), res("a", "out"), res("a", "again"), "{bad", json.dumps({"message": {"content": "text"}})]))
    got = usage.tool_pairs(jsonl.tool_blocks(jsonl.transcripts(spark, str(tmp_path))))
    assert [(r.use, r.result) for r in got.collect()] == [("two", "out")]


def test_artifacts(spark):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([(1, "x" * 100), (2, "short")], "id int, t string")
    got = {r.id: r for r in dedup.verified(artifacts.with_hashes(df, "t", 60)).collect()}
    assert got[1].truncated and not got[2].truncated and got[1].ok and got[2].ok and len(got[1].data) == 60
    idx = spark.createDataFrame([(f"r{i}", t + timedelta(days=i), f"/t/f{i}.log", "ls", "p", "/w", 10) for i in range(5)], "id string, timestamp timestamp, path string, command string, profile string, cwd string, raw_bytes long")
    assert rows(artifacts.pruned(idx, 4, 25)) == [("r0", False), ("r1", False), ("r2", False), ("r3", True), ("r4", True)]
    assert artifacts.find(idx, "f2.log").first().id == "r2" and artifacts.search(idx, "F3").first().id == "r3"


def test_previous_within(spark):
    t = datetime(2025, 1, 1)
    data = [(1, "k", t), (2, "k", t + timedelta(minutes=29)), (3, "k", t + timedelta(minutes=61)), (4, None, t), (5, None, t), (6, "k", None)]
    df = spark.createDataFrame(data, "id long, k string, ts timestamp_ntz")
    got = {r.id: r.prev and r.prev.id for r in dedup.previous_within(df, ["k"], "ts", "id").collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: 4, 6: None}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("12:00:01 ERROR boom\n12:00:02 ERROR boom\nplain\n")
    s = streams.log_summary(streams.tail_text(spark, str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("logs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.severity, r.n) for r in spark.table("logs").collect()) == [("ERROR", 2), ("other", 1)]


def test_repeats(spark, tmp_path):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([(1, "h", t), (2, "h", t + timedelta(minutes=10)), (3, "h", t + timedelta(hours=2)), (4, "g", t)], "id long, hash string, ts timestamp")
    df.write.parquet(str(tmp_path / "r"))
    s = streams.session_repeats(spark.readStream.schema(df.schema).parquet(str(tmp_path / "r")), expire=False)
    q = s.writeStream.format("memory").queryName("reps").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("reps").collect()] == [(2, 1, 1)]
