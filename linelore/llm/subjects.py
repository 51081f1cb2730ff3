"""Subject areas of documents by a classifier of sentences.

A sentence is the mean of its words' vectors; a word's vector is its own embedding plus the mean of its subwords'
(character n-grams, so slips of spelling and unseen forms still have one); seven or however many subjects have independent
logistic outputs. Training starts from documents with one label, whose sentences all count as being about it; sentences
that occur under every label (greetings, remarks) stay undecided, so a second phase takes the model's own reading of
each sentence as its target, and with it the mixed documents. Every round each partition computes the gradient of its
share of the labelled documents and the driver adds the gradients up (a row for each touched vector) and moves the
model. The number of labelled documents is bounded by MAX_LABELLED; scoring reads every document.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelore.session import cut_lineage

MAX_LABELLED = 6_000  # documents that the model is fitted on, chosen by a hash of their id
MOST_SHARDS = 64  # a shard has about a hundred labelled documents then
DIM = 10
WORDS, SUBWORDS = 1 << 15, 1 << 16
ROUNDS = (24, 24)
RATE = 0.15
LEAST_SHARE = 0.2  # of a document's sentences that have a subject at all
SURE = 0.5
NEAR = 3.0  # outputs that are so near to the greatest may be the sentence's subject too

_ANSI = re.compile(r"\x1b(?:\[[0-?]*[ -/]*[@-~]|[ -/]*[0-~])")
_LEAD = re.compile(r"^(?:[\s>*#\-+│├└─•]|\[[^\]]*\]|\d{4}-\d\d-\d\dT\S+|(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL)\b|(?:assistant|user|system|tool_result|tool_use|tool|human)\s*:|[a-z]+(?:\([^)]*\))?!?:(?= ))+")
_CODE = re.compile(r"^\s*(?:\$ |@@ |exit \d|\*\*.*:$)|\w ?= ?\w|[A-Za-z_][\w-]*/\w|[│├└]")
_CELL = re.compile(r"\s\|\s|^\||\|$")
_END = re.compile(r"(?<=[.!?])[\s​]+(?=[^\s])")
_WORD = re.compile(r"[^\W\d_]+")
LEAST_WORDS = 3


def _prose(line: str) -> list[str]:
    """The parts of a line that may be prose: the texts of a JSON object, the cells of a table, or the line; none for code."""
    if line[:1] == "{" and line[-1:] == "}":
        try:
            o = json.loads(line)
            return [v for v in o.values() if isinstance(v, str)] if isinstance(o, dict) else []
        except (ValueError, RecursionError):
            return []
    if _CODE.search(line):
        return []
    return _CELL.split(line) if "|" in line else [line]


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of a text; lines that are commands, paths, counters and the like have none.

    A sentence of fewer than LEAST_WORDS words (a greeting, a label, a prompt) is about nothing and counts for no subject.
    """
    out = []
    for line in (text or "").split("\n"):
        for part in _prose(_ANSI.sub("", line).strip()):
            for s in _END.split(_LEAD.sub("", part)):
                words = [w.lower() for w in _WORD.findall(s)]
                if len(words) >= LEAST_WORDS:
                    out.append(words)
    return out


def features(word: str) -> tuple[int, list[int]]:
    """The rows of a word's own embedding and of its subwords'."""
    b = word.encode("utf-8", "surrogatepass")
    w = f"<{word}>"
    grams = [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return zlib.crc32(b) % WORDS, [WORDS + zlib.crc32(g.encode("utf-8", "surrogatepass")) % SUBWORDS for g in grams] or [WORDS]


def initial(subjects: int, seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {"E": r.normal(0, 0.1, (WORDS + SUBWORDS, DIM)).astype(np.float32), "W": r.normal(0, 0.5, (DIM, subjects)).astype(np.float32), "b": np.full(subjects, -1.5, np.float32)}


class Shard:
    """Labelled documents as arrays: distinct words, their rows, and the words of each sentence."""

    def __init__(self, texts: list[str], labels: list[list[int]], n_subjects: int):
        vocab: dict[str, int] = {}
        words, start, owner = [], [], []
        for d, t in enumerate(texts):
            for s in sentences(t):
                start.append(len(words))
                owner.append(d)
                words.extend(vocab.setdefault(w, len(vocab)) for w in s)
        feats = [features(w) for w in vocab]
        self.n = len(start)
        self.words, self.start, self.owner = np.array(words, np.int64), np.array(start, np.int64), np.array(owner, np.int64)
        self.length = np.diff(np.append(self.start, len(words))).astype(np.float32)
        own = np.array([f[0] for f in feats], np.int64)
        size = np.array([len(f[1]) for f in feats], np.int64)
        grams = np.array([g for f in feats for g in f[1]], np.int64)
        self.rows, inverse = np.unique(np.concatenate([own, grams]), return_inverse=True)
        self.own, self.grams = inverse[: len(own)], inverse[len(own) :]
        self.size, self.gram_word = size.astype(np.float32), np.repeat(np.arange(len(own)), size)
        self.gram_start = np.append(0, np.cumsum(size))[:-1]
        self.y = np.zeros((len(texts), n_subjects), np.float32)
        for d, ls in enumerate(labels):
            self.y[d, ls] = 1
        self.single = self.y.sum(1) == 1
        self.sentence_of_word = np.repeat(np.arange(self.n), self.length.astype(np.int64))

    def logits(self, m: dict[str, np.ndarray], e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = e[self.own] + np.add.reduceat(e[self.grams], self.gram_start, axis=0) / self.size[:, None]
        h = np.add.reduceat(v[self.words], self.start, axis=0) / self.length[:, None]
        return h, h @ m["W"] + m["b"]

    def gradient(self, m: dict[str, np.ndarray], phase: int, balance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, float]:
        """Touched rows and their gradient, those of W and b, the loss and the weight. ``balance`` weighs rare labels up."""
        k = m["b"].shape[0]
        if not self.n:
            return self.rows, np.zeros((len(self.rows), DIM), np.float32), np.zeros((DIM, k), np.float32), np.zeros(k, np.float32), 0.0, 0.0
        e = m["E"][self.rows]
        h, z = self.logits(m, e)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if phase == 0:
            y = self.y[self.owner]
            weight = np.where(self.single[self.owner], (y * balance).sum(1), 0).astype(np.float32)
        else:
            best, sure = p.argmax(1), p.max(1)
            stated = self.y[self.owner, best] > 0
            y = np.zeros_like(p)
            # what occurs under every label has one chance in the number of subjects; a sentence about one far more
            about = sure >= np.where(stated, 0.45, 0.8)
            y[np.flatnonzero(about), best[about]] = 1
            weight = (about | (sure < 0.35)).astype(np.float32)
        d = (p - y) * weight[:, None]
        loss = -(weight[:, None] * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum()
        dh = (d @ m["W"].T) / self.length[:, None]
        dw = _sum_by(self.words, dh[self.sentence_of_word], len(self.own))
        de = _sum_by(self.own, dw, len(self.rows)) + _sum_by(self.grams, (dw / self.size[:, None])[self.gram_word], len(self.rows))
        return self.rows, de, h.T @ d, d.sum(0), float(loss), float(weight.sum())


def _sum_by(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, x[:, j], n) for j in range(x.shape[1])], axis=1).astype(np.float32)


def balanced(counts: list[int]) -> np.ndarray:
    """Weights by which all labels count alike; their mean over the rows is 1."""
    n = np.array(counts, np.float32)
    return (max(1.0, n.sum()) / max(1, (n > 0).sum()) / np.maximum(n, 1)).clip(0, 20).astype(np.float32)


class Adam:
    def __init__(self, m: dict[str, np.ndarray], rate: float = RATE):
        self.m, self.rate, self.t = m, rate, 0
        self.a = {k: np.zeros_like(v) for k, v in m.items()}
        self.s = {k: np.zeros_like(v) for k, v in m.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            self.a[k] += 0.1 * (x - self.a[k])
            self.s[k] += 0.01 * (x * x - self.s[k])
            a, s = self.a[k] / (1 - 0.9**self.t), self.s[k] / (1 - 0.99**self.t)
            self.m[k] -= (self.rate * (0.3 if k == "E" else 1.0) * a / (np.sqrt(s) + 1e-8)).astype(np.float32)


_KEPT: dict[tuple, Shard] = {}  # a worker keeps the shards that it has prepared


def _round(m, phase: int, balance: np.ndarray, run: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        key = (run, rows[0]["shard"])
        if key not in _KEPT:
            if len(_KEPT) > 4 * MOST_SHARDS:
                _KEPT.clear()
            _KEPT[key] = Shard([r["text"] for r in rows], [r["labels"] for r in rows], len(balance))
        at, de, dw, db, loss, weight = _KEPT[key].gradient(m.value, phase, balance)
        yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int64), de.astype(np.float32), dw.astype(np.float32), db.astype(np.float32))] + [pa.array([loss]), pa.array([weight])], names=["rows", "de", "dw", "db", "loss", "weight"])

    return go


def labelled(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int = MAX_LABELLED, shards: int = 1) -> DataFrame:
    """``text, labels, shard``: at most ``most`` labelled documents; labels are places in ``subjects``, doubled ones count once."""
    place = F.array_position(F.array(*[F.lit(s) for s in subjects]), F.col("subject")).cast("int") - 1
    one = labels.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_set(place)).alias("labels"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded: it may be broadcast
    docs = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(one), "doc_id")
    return docs.select("text", "labels", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))


def train(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int = MAX_LABELLED, rounds: tuple[int, int] = ROUNDS) -> dict[str, np.ndarray]:
    """The model's arrays. Without usable labels it is the untrained one, which finds no subject."""
    spark = documents.sparkSession
    k = len(subjects)
    shards = max(1, min(MOST_SHARDS, spark.sparkContext.defaultParallelism))  # as many as the cluster has cores
    data = cut_lineage(labelled(documents, labels, subjects, most, shards).repartition(shards, "shard").sortWithinPartitions("shard", "text"))
    data = data.withColumn("shard", F.spark_partition_id())  # a partition is one shard, however the hash fell
    m = initial(k)
    if data.isEmpty():
        return m | {"b": np.full(k, -30, np.float32)}
    seen = {r.label: r.n for r in data.where("size(labels) = 1").groupBy(F.col("labels")[0].alias("label")).agg(F.count("*").alias("n")).collect()}
    balance = balanced([seen.get(i, 0) for i in range(k)])
    adam, run = Adam(m), f"{id(m)}-{spark.sparkContext.applicationId}-{np.random.SeedSequence().entropy}"
    for phase, n in enumerate(rounds):
        for _ in range(n):
            sent = spark.sparkContext.broadcast(m)
            parts = data.mapInArrow(_round(sent, phase, balance, run), "rows binary, de binary, dw binary, db binary, loss double, weight double").collect()  # a row a shard
            g = {x: np.zeros_like(v) for x, v in m.items()}
            weight = max(1.0, sum(p["weight"] for p in parts))
            for p in parts:
                g["E"][np.frombuffer(p["rows"], np.int64)] += np.frombuffer(p["de"], np.float32).reshape(-1, DIM) / weight
                g["W"] += np.frombuffer(p["dw"], np.float32).reshape(DIM, k) / weight
                g["b"] += np.frombuffer(p["db"], np.float32) / weight
            adam.step(g)
            sent.destroy()
    return m


class Scorer:
    """Subjects of sentences and documents; the outputs of words that were seen are kept in a growing table."""

    MOST_WORDS = 200_000

    def __init__(self, m: dict[str, np.ndarray]):
        self.m, self.rows, self.z = m, {}, np.zeros((1024, len(m["b"])), np.float32)

    def row(self, w: str) -> int:
        i = self.rows.get(w)
        if i is None:
            i = self.rows[w] = len(self.rows)
            if i == len(self.z):
                self.z = np.concatenate([self.z, np.zeros_like(self.z)])
            own, grams = features(w)
            self.z[i] = (self.m["E"][own] + self.m["E"][grams].mean(0)) @ self.m["W"]
        return i

    def outputs(self, sents: list[list[str]]) -> np.ndarray:
        """One row of outputs per sentence, all at once."""
        if not sents:
            return np.zeros((0, len(self.m["b"])), np.float32)
        if len(self.rows) > self.MOST_WORDS:
            self.rows = {}
        get, ids, size = self.rows.get, [], []
        for s in sents:
            ids += [i if (i := get(w)) is not None else self.row(w) for w in s]
            size.append(len(s))
        size = np.array(size)
        start = np.cumsum(size) - size
        return np.add.reduceat(self.z[ids], start, axis=0) / size[:, None] + self.m["b"]

    def sentence(self, words: list[str]) -> int:
        """The place of the subject, -1 for none."""
        z = self.outputs([words])[0]
        i = int(z.argmax())
        return i if z[i] >= np.log(SURE / (1 - SURE)) else -1

    def counts_of(self, texts: list[str | None]) -> list[list[int]]:
        """Sentences of each subject, for each text. One that may be about two subjects counts for the one that the rest of the text is about."""
        sents = [sentences(t) for t in texts]
        z = self.outputs([s for d in sents for s in d])
        best, sure = z.argmax(1), z.max(1, initial=-np.inf) if len(z) else np.zeros(0)
        about = sure >= np.log(SURE / (1 - SURE))
        near = z >= sure[:, None] - NEAR if len(z) else z.astype(bool)
        twofold = near.sum(1) > 1
        out, k = [], 0
        for d in sents:
            at = np.flatnonzero(about[k : k + len(d)]) + k
            k += len(d)
            n = np.bincount(best[at], minlength=z.shape[1]).tolist()
            final = list(n)
            for j in at[twofold[at]].tolist():
                b = int(best[j])
                c = max(np.flatnonzero(near[j]).tolist(), key=lambda x: (n[x] - (x == b), z[j, x]))
                final[b] -= 1
                final[c] += 1
            out.append(final)
        return out

    def counts(self, text: str | None) -> list[int]:
        return self.counts_of([text])[0]


def score(documents: DataFrame, model: dict[str, np.ndarray], subjects: list[str]) -> DataFrame:
    """``doc_id, subject, n_sentences, share``: the subjects of every document with their part of its sentences."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for d, n in zip(part.column(0).to_pylist(), s.counts_of(part.column(1).to_pylist())):
                    total = sum(n)
                    rows += [(d, subjects[i], x, x / total) for i, x in enumerate(n) if x]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=["doc_id", "subject", "n_sentences", "share"])

    src = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return src.mapInArrow(run, "doc_id bigint, subject string, n_sentences bigint, share double")


def subject_names(subjects: DataFrame) -> list[str]:
    names = [r[0] for r in subjects.select("subject").where("subject is not null").distinct().orderBy("subject").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 subject areas")
    return names


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """``doc_id, subject``: each subject that at least ``least_share`` of a document's sentences with a subject are about.

    Null, empty and blank texts, and texts of commands, paths and counters only, have none. Repeated documents are scored
    each; labels that name no known subject or document are ignored; texts in any language are read whole.
    """
    names = subject_names(subjects)
    if not names:
        return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("subject")).where("false")
    s = score(documents, train(documents, labels, names), names)
    return s.where(F.col("share") >= least_share - 1e-9).select("doc_id", "subject")
