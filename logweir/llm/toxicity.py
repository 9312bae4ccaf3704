"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over hashed byte n-grams of
its lower-cased text; the bag's probability is the noisy-or of its sentences', and the weights are
learned from document labels alone. The sentence scores then show where a document offends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_text, labelled_sample, rebatch, tidy
from .near_dup import mix

BITS = 18
GRAMS = (5, 7)  # bytes
START = -10.0  # bias before learning: a calm sentence hardly counts, so thousands of them do not add up
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?\n"]] = True


def sentence_starts(data: np.ndarray) -> np.ndarray:
    """Byte positions where sentences start: 0, and after each run of . ! ? or line ends."""
    stop = STOPS[data]
    return np.concatenate([[0], np.flatnonzero(stop[:-1] & ~stop[1:]) + 1]) if len(data) else np.zeros(0, np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams at each byte (len(GRAMS) rows; past the end they see zeros); sentence starts.

    They run over sentence ends, which are bytes like others.
    """
    raw = text.encode().lower()
    data = np.frombuffer(raw, np.uint8)
    buf = raw + b"\0" * 8
    v = np.ndarray((len(raw),), "<u8", buf, strides=(1,))
    out = np.empty((len(GRAMS), len(raw)), np.int32)
    for i, n in enumerate(GRAMS):
        h = mix(v & np.uint64((1 << 8 * n) - 1))
        out[i] = (h >> np.uint64(64 - BITS)).astype(np.int32) + (i << BITS)
    return out, sentence_starts(data)


@dataclass
class ToxicityModel:
    """weights by hashed n-gram; bias of a sentence. Apply with ``score``; both are small at any input size."""

    weights: np.ndarray
    bias: float

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the sentences (in bytes) and their probabilities."""
        ids, at = grams(text)
        if not len(at):
            return at, np.zeros(0)
        z = np.add.reduceat(self.weights[ids].sum(axis=0), at) + self.bias
        return at, 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, text: str) -> tuple[float, int, int, float]:
        """Noisy-or; number of sentences at 0.3 or more; start and probability of the worst (-1, 0 if none)."""
        at, p = self.sentences(text)
        if not len(p):
            return 0.0, 0, -1, 0.0
        worst = int(p.argmax())
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), int((p >= 0.3).sum()), int(at[worst]), float(p[worst])


def differs(n0, n1, total0, total1, root):
    """By how many standard errors an n-gram's share of documents differs between the classes; numbers, arrays or columns."""
    whole = (n0 + n1) / (total0 + total1)
    gap = n1 / total1 - n0 / total0
    return root(gap * gap) / root((whole * (1 - whole) + 1e-9) * (1 / total0 + 1 / total1))


def ranks(kept: np.ndarray) -> np.ndarray:
    """n-gram -> its place among the kept ones, or -1."""
    out = np.full(len(GRAMS) << BITS, -1, np.int32)
    out[kept] = np.arange(len(kept))
    return out


def small(n: int) -> np.dtype:
    """The smallest type that holds numbers below n."""
    return np.min_scalar_type(max(1, n))


def bag(text: str, rank: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of sentences; the places of the text's kept n-grams, sentence by sentence, and how many each sentence has."""
    ids, at = grams(text)
    if not len(at):
        return 0, np.zeros(0, np.int32), np.zeros(0, np.int32)
    inst = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, ids.shape[1])))
    at_kept = rank[ids]
    found, inst = np.concatenate([row[row >= 0] for row in at_kept]), np.concatenate([inst[row >= 0] for row in at_kept])
    return len(at), found[np.argsort(inst, kind="stable")], np.bincount(inst, minlength=len(at)).astype(np.int32)


def constant(labels: list[int]) -> ToxicityModel:
    """Without both classes: the base rate alone, as a bias."""
    return ToxicityModel(np.zeros(len(GRAMS) << BITS), 4.0 if labels and labels[0] else -12.0)


def train(texts: list[str], labels: list[int], zmin: float = 5.5, **kw) -> ToxicityModel:
    """As ``ToxicityClassifier.fit``, on texts at hand."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return constant(labels)
    df = np.zeros((2, len(GRAMS) << BITS))
    for k, t in enumerate(texts):
        df[labels[k], np.unique(grams(t)[0])] += 1
    kept = np.flatnonzero(differs(df[0], df[1], (y == 0).sum(), (y == 1).sum(), np.sqrt) >= zmin)
    rank = ranks(kept)
    return learn([(*bag(t, rank), label) for t, label in zip(texts, labels, strict=True)], kept, **kw)


def learn(bags: list[tuple[int, np.ndarray, np.ndarray, int]], kept: np.ndarray, steps: int = 60, rate: float = 0.5, l2: float = 1e-4) -> ToxicityModel:
    """Adagrad on the noisy-or's log loss of bags (number of sentences, places of n-grams among the kept, how many each sentence has, label)."""
    y = np.array([b[3] for b in bags], float)
    sizes = np.array([b[0] for b in bags])
    n = int(sizes.sum())
    if not n:
        return ToxicityModel(np.zeros(len(GRAMS) << BITS), -12.0)
    f = np.concatenate([b[1] for b in bags])
    inst = np.repeat(np.arange(n), np.concatenate([b[2] for b in bags]))
    of = np.repeat(np.arange(len(bags)), sizes)
    used, f = np.unique(f, return_inverse=True)
    w, gw, b, gb = np.zeros(len(used)), np.full(len(used), 1e-6), START, 1e-6
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    for _ in range(steps):
        d, db = gradient(w, b, f, inst, of, y, share)
        d += l2 * w
        gw += d * d
        w -= rate * d / np.sqrt(gw)
        gb += db * db
        b -= rate * db / np.sqrt(gb)
    full = np.zeros(len(GRAMS) << BITS)
    full[kept[used]] = w
    return ToxicityModel(full, float(b))


def gradient(w: np.ndarray, b: float, f: np.ndarray, inst: np.ndarray, of: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the weighted mean log loss of the bags' noisy-or, by weights and bias. f: n-grams, inst: their sentences, of: the sentences' bags."""
    z = np.clip(np.bincount(inst, w[f], len(of)) + b, -30, 30)
    p = np.minimum(1 / (1 + np.exp(-z)), 1 - 1e-9)
    none = np.exp(np.bincount(of, np.log1p(-p), len(y)))
    whole = np.maximum(1 - none, 1e-9)
    g = p * np.where(y == 1, -none / whole, 1.0)[of] * share[of] / len(y)
    return np.bincount(f, g[inst], len(w)), float(g.sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, label) -> n-gram, documents of either label that hold it, summed over a task."""
    df = np.zeros((2, len(GRAMS) << BITS), np.int64)
    for b in rebatch(batches):
        for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            df[label, np.unique(grams(t)[0])] += 1
    ids = np.flatnonzero(df.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(df[0, ids]), pa.array(df[1, ids])], names=["gram", "n0", "n1"])


def _bags(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, kind = ranks(shared.value), small(len(shared.value))
        for b in rebatch(batches):
            got = [bag(t, rank) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1].astype(kind).tobytes() for g in got], pa.binary()), pa.array([g[2].tobytes() for g in got], pa.binary())], names=["doc_id", "label", "n", "grams", "sentences"])

    return tidy(run)


SCORES = "doc_id long, score double, n_toxic_sentences int, worst_start int, worst_score double"


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in rebatch(batches):
            got = [model.score(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], k) for i, k in enumerate((pa.float64(), pa.int32(), pa.int32(), pa.float64())))], names=["doc_id", "score", "n_toxic_sentences", "worst_start", "worst_score"])

    return tidy(run)


class ToxicityClassifier:
    """per_class, max_chars: the learning sample's documented bounds (documents of each label; their length).
    zmin: standard errors by which an n-gram's share of documents must differ between the classes."""

    def __init__(self, per_class: int = 3000, max_chars: int = 40_000, zmin: float = 5.5):
        self.per_class, self.max_chars, self.zmin, self.model = per_class, max_chars, zmin, None

    def fit(self, docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> ToxicityClassifier:
        """labels (doc_id, toxic). learn_from: which rows of labels to learn from, by default all.

        N-grams are counted and selected in Spark; the driver gets the selected ones of the sample, never a text.
        """
        rows = labelled_sample(labels, "toxic", F.lit(True) if learn_from is None else learn_from, self.per_class)
        text = id_text(docs).where(F.length("text") <= self.max_chars).join(F.broadcast(rows), "doc_id").select("doc_id", "text", "label")
        n = {r.label: r.n for r in text.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            self.model = constant(list(n))
            return self
        df = text.select("text", "label").mapInArrow(_counts, "gram int, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        kept = df.where(differs(F.col("n0"), F.col("n1"), n[0], n[1], F.sqrt) >= self.zmin).select("gram").collect()
        kept = np.array(sorted(r.gram for r in kept), np.int64)
        shared = docs.sparkSession.sparkContext.broadcast(kept)
        got = text.mapInArrow(_bags(shared), "doc_id long, label int, n int, grams binary, sentences binary").collect()
        got = sorted((r.doc_id, r.label, r.n, bytes(r.grams), bytes(r.sentences)) for r in got)
        self.model = learn([(g[2], np.frombuffer(g[3], small(len(kept))), np.frombuffer(g[4], np.int32), g[1]) for g in got], kept)
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        """A row per row of docs: doc_id, score, and where it offends most. Null and empty texts score 0."""
        shared = docs.sparkSession.sparkContext.broadcast(self.model)
        return id_text(docs).mapInArrow(_apply(shared), SCORES)

    def clean(self, docs: DataFrame, at: float = 0.3) -> DataFrame:
        """docs without those that score ``at`` or more; all other rows and all columns stay."""
        shared = docs.sparkSession.sparkContext.broadcast(self.model)
        return docs.mapInArrow(_keep(shared, at), docs.schema)


def _keep(shared, at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in rebatch(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([model.score(t or "")[0] < at for t in texts], pa.bool_()))

    return tidy(run)


def toxicity(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """Contract of op9: learn without the held-out rows, score every document.

    A row per row of docs, null ids (held out) and repeated rows included; equal texts have equal scores. Null and empty texts score 0 and offend nowhere
    (worst_start -1); texts of any length are scored whole, and of equally bad sentences the first is the worst. labels that are null or have a null id teach
    nothing, of an id's several labels the least counts; without labels of both kinds all texts score alike. An empty table gives an
    empty result; further columns are not read.
    """
    out = (held_out(F.col("doc_id").cast("long"), 4, 2)).alias("held_out")
    scored = ToxicityClassifier().fit(docs, labels, ~held_out(F.col("doc_id").cast("long"), 4, 2)).score(docs)
    return scored.select("doc_id", out, "score", (F.col("score") >= at).cast("int").alias("predicted"), "n_toxic_sentences", "worst_start", "worst_score")
