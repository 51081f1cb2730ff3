import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from linelore.llm import encoding, heavy_hitters, mixing, nearest_time, quantiles, runs, subjects

T0 = datetime(2025, 9, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_learned_index():
    r = np.random.default_rng(0)
    for keys in (np.array([5]), np.unique(r.integers(0, 10**15, 3000)), np.concatenate([[nearest_time.LOWEST], np.arange(1000) * 7]), np.unique((r.pareto(1, 2000) * 1e6).astype(np.int64))):
        q = np.concatenate([keys, keys + 1, r.integers(max(0, keys[0]), keys[-1] + 10, 500)])
        q = q[q >= keys[0]]
        assert (nearest_time.LearnedIndex(keys).predecessor(q) == np.searchsorted(keys, q, "right") - 1).all()


def test_nearest_against_brute_force(spark):
    r = random.Random(2)
    ses = []
    for i in range(150):
        a = T0 + timedelta(seconds=r.randrange(200_000))
        ses.append((f"s{i:03}", r.choice(["/hot", "/hot", "/a", None]), a, a + timedelta(seconds=r.choice([0, 5, 600, 90_000]))))
    ses += [("dup1", "/a", T0, T0), ("dup2", "/a", T0, T0), ("bad", "/a", T0, T0 - timedelta(1)), (None, "/a", T0, T0)]
    rec = [(k, r.choice(["/hot", "/a", "/none", None]), None if r.random() < 0.02 else T0 + timedelta(seconds=r.randrange(-300, 201_000))) for k in range(800)] + [(900, "/a", T0), (900, "/a", T0)]
    want = []
    for k, d, t in rec:
        best = None
        for s, sd, a, b in ses:
            if s is None or d is None or t is None or sd != d or b < a:
                continue
            dist = max(timedelta(0), a - t, t - b)
            key = (dist, T0 - a, s)
            if dist <= timedelta(seconds=120) and (best is None or key < best):
                best = key
        if best:
            want.append((k, best[2]))
    R = spark.createDataFrame(rec, "seq long, dir string, t timestamp_ntz")
    S = spark.createDataFrame(ses, "id string, dir string, a timestamp_ntz, b timestamp_ntz")
    run = lambda R, S: nearest_time.nearest_interval(R, (R.seq, R.dir, R.t), S, (S.id, S.dir, S.a, S.b), 120, 3600)
    assert rows(run(R, S)) == sorted(want, key=repr)
    # crowded stretches are cut, very long intervals have wider ones; neither changes a row
    crowded = nearest_time.nearest_interval(R, (R.seq, R.dir, R.t), S, (S.id, S.dir, S.a, S.b), 120, 3600, crowd=20)
    assert rows(crowded) == sorted(want, key=repr)
    assert rows(nearest_time.nearest_interval(R, (R.seq, R.dir, R.t), S, (S.id, S.dir, S.a, S.b), 120, 1)) == sorted(want, key=repr)
    assert run(R, S.where("false")).count() == 0 and run(R.where("false"), S).count() == 0


@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_percentiles(spark, method):
    r = random.Random(5)
    data = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice(["x", None]), r.choice([None, r.randrange(50), r.randrange(10**6)])) for _ in range(3000)] + [("one", "x", 7)]
    df = spark.createDataFrame(data, "g string, h string, value long")
    parts = [quantiles.value_counts(df.where(F.col("value") % 2 == i), ["g", "h"], "value") for i in (0, 1)]
    got = quantiles.percentiles(quantiles.combine(parts), ["g", "h"], [50, 95, 100], method)
    groups = {}
    for g, h, v in data:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    want = []
    for k, v in groups.items():
        v.sort()
        ps = [float(v[max(1, -(-len(v) * p // 100)) - 1]) if method == "nearest" else float(np.percentile(v, p)) for p in (50, 95, 100)]
        want.append((*k, len(v), *ps))
    a, b = rows(got), sorted(want, key=repr)
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3:] for x in a], [x[3:] for x in b])
    assert quantiles.percentiles(parts[0].where("false"), ["g", "h"], [50]).count() == 0


@pytest.mark.parametrize("width,reuse", [(1, "true"), (7, "false"), (64, "true"), (64, "false")])
def test_percentiles_do_not_depend_on_reused_exchanges(spark, width, reuse):
    r = random.Random(8)
    data = [(r.choice(["hot"] * 5 + ["b", "c", None]), r.randrange(10**6)) for _ in range(6000)]
    df = spark.createDataFrame(data, "g string, value long")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.exchange.reuse")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        for held in (quantiles.HELD, 10):  # groups above the bound are read as they pass
            got = quantiles.percentiles(quantiles.value_counts(df, ["g"], "value"), ["g"], [50, 99], held=held)
            want = []
            for g in {x[0] for x in data}:
                v = sorted(x[1] for x in data if x[0] == g)
                want.append((g, len(v), *(float(v[-(-len(v) * p // 100) - 1]) for p in (50, 99))))
            assert rows(got) == sorted(want, key=repr)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_runs(spark):
    text = "a 1\r\n\na 2\n \x1b[2ma  3\x1b[0m\nb\nb\nlayer 543cb346 x\nlayer 12345678 x\nlayer a9dc16cd x\n" + "." + "\n.\n\n." * 400
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x\ny\nz"), (5, "Sep 10 02:44:06 q\nSep  1 02:45:06 q\nOct 11 00:00:00 q")], "capture_id long, raw_combined string")
    assert rows(runs.found_runs(df)) == sorted([(1, 1, 4), (1, 7, 9), (1, 10, 1210), (5, 1, 3)], key=repr)
    assert runs.found_runs(df.where("false")).count() == 0
    got = {(r.seq_id, r.first_line): (r.last_line, r.n) for r in runs.collapsed(df, "capture_id", "raw_combined").collect()}
    assert got[1, 5] == (6, 2) and got[1, 10] == (1210, 801) and got[4, 1] == (1, 1)
    assert {k[0] for k in got} == {1, 4, 5}
    three = {(r.seq_id, r.first_line): r.n for r in runs.collapsed(df, "capture_id", "raw_combined", 3).collect()}
    assert three[1, 5] == three[1, 6] == 1 and three[1, 10] == 801
    twice = runs.collapsed(df.union(df), "capture_id", "raw_combined")
    assert {(r.seq_id, r.first_line): (r.last_line, r.n) for r in twice.collect()} == got


def test_frequent(spark):
    r = random.Random(7)
    data = [("hot" if r.random() < 0.3 else "warm" if r.random() < 0.02 else f"v{r.randrange(5000)}" if r.random() < 0.9 else None,) for _ in range(6000)]
    df = spark.createDataFrame(data, "c string").repartition(20)
    got = heavy_hitters.frequent_items(df, {"c": F.col("c")}, 0.01, 200).select("item", "n")
    counts = {}
    for (c,) in data:
        if c is not None:
            counts[c] = counts.get(c, 0) + 1
    assert rows(got) == sorted(((k, n) for k, n in counts.items() if n >= 60), key=repr)
    assert heavy_hitters.frequent_items(df.where("false"), {"c": F.col("c")}).count() == 0
    with pytest.raises(ValueError):
        heavy_hitters.frequent_items(df, {"c": F.col("c")}, 0.001, 500)


def test_encoding(spark):
    enc = encoding.codec().encode_ordinary
    r = random.Random(9)
    texts = ["it's 5 o'clock, y'all''ll", "  \t\n  x", "日本語 text​\x1c\x85!?", "<|endoftext|>", "a" * 5000, "1" * 3000 + "b" * 3000 + "'" * 50 + "s", " " * 4000, "'s" * 500]
    texts += ["".join(r.choice("ab1 .'\n\té日🧪s") for _ in range(r.randrange(400))) for _ in range(150)]
    for t in texts:
        for size in (1, 3, 17, 256):
            assert encoding.encode_text(t, enc, size) == enc(t)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (3, "hello world")], "doc_id long, text string")
    got = rows(encoding.encode(df, ["doc_id"]))
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] == (3, enc("hello world"))
    assert {x.text for x in encoding.decode(encoding.encode(df, ["doc_id"]), ["doc_id"]).collect()} == {"", "hello world"}


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, pi = rng.integers(1, 900, 500).astype(float), np.full(500, 0.37)
    out = mixing.flight(size, pi, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * size).sum() - (pi * size).sum()) < 1e-3
    assert set(mixing.landing(size, out)) <= {0.0, 1.0}


def test_mix(spark):
    r = random.Random(3)
    docs = [(i, r.choice(["big", "big", "big", "small", None, "other"]), r.choice([None, ""]) if r.random() < 0.05 else "word " * r.randrange(1, 60)) for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    sel = mixing.select_mix(df, targets).collect()
    assert len({x.doc_id for x in sel}) == len(sel) and {x.source for x in sel} == {"big", "small"}
    assert max(x.repeats for x in sel if x.source == "big") == 1 and max(x.repeats for x in sel if x.source == "small") <= 3
    tok = {s: sum(x.n_tokens * x.repeats for x in sel if x.source == s) for s in ("big", "small")}
    assert abs(tok["big"] / tok["small"] - 0.5 / 0.4) < 0.02
    assert mixing.select_mix(df.where("false"), targets).count() == 0
    # hardly any document in a partition: all of them undecided at first
    few = mixing.select_mix(df.limit(25).repartition(12), targets).collect()
    assert len({x.doc_id for x in few}) == len(few) > 0


def test_subjects(spark):
    r = random.Random(1)
    words = {"law": "court judge verdict clause appeal witness".split(), "sport": "goal match striker league podium sprint".split()}
    line = lambda s: f"The {r.choice(words[s])} and the {r.choice(words[s])} follow once."
    docs, labels = [], []
    for i in range(160):
        s = "law" if i % 2 else "sport"
        docs.append((i, "\n".join([line(s) for _ in range(6)] + ["It took longer than planned.", "$ git status", "a/b.go:3:4"])))
        if i < 80:
            labels += [(i, s, "r"), (i, s, "r")]
    docs += [(500, None), (501, ""), (502, "$ ls -la\n12:00:01"), (503, "\n".join([line("law")] * 4 + [line("sport")]))]
    D = spark.createDataFrame(docs, "doc_id long, text string")
    L = spark.createDataFrame([*labels, (9999, "law", "r"), (1, "cooking", "r")], "doc_id long, subject string, rater string")
    S = spark.createDataFrame([("law", ""), ("sport", "")], "subject string, about string")
    got = {}
    for d, s in rows(subjects.document_subjects(D, L, S)):
        got.setdefault(d, set()).add(s)
    assert sum(got.get(i) == {"law" if i % 2 else "sport"} for i in range(80, 160)) >= 76
    assert not {500, 501, 502} & set(got) and got[503] == {"law", "sport"}
    assert subjects.document_subjects(D, L.where("false"), S).count() == 0
