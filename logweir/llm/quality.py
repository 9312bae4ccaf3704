"""Quality by Bradley-Terry ranking.

Pairs of a better and a worse document are preferences; a document's worth is linear in features of
its whole text, and the weights minimise the logistic loss on feature differences. The threshold is
the quantile of the scores below which the share of worse documents lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_text, labelled_sample, rebatch

CLASSES = np.full(256, 9)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\f\v", "\n", ".,;:'\"()-", "!?", "|", "#$%&*<>=+/\\^~_@{}[]`"]):
    CLASSES[[ord(c) for c in _chars]] = _k
CLASSES[:9] = CLASSES[14:32] = 10
CLASSES[127] = 10
N_CLASSES, N_FEATURES = 11, 22


def features(text: str) -> np.ndarray:
    """Shares of byte classes, words and lines; all in 0..1 or logarithms. An empty text has zeros and a flag."""
    out = np.zeros(N_FEATURES)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        out[-1] = 1
        return out
    out[:N_CLASSES] = np.sqrt(np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES)[:N_CLASSES] / len(raw))
    low = [w.lower() for w in words]
    distinct = len(set(low))
    lines = [x for x in raw.split(b"\n") if x]
    out[11] = distinct / n
    out[12] = np.log(distinct + 1) / np.log(n + 1)  # less bound to the length than the share
    out[13] = sum(map(bytes.__eq__, low, low[1:])) / n
    out[14] = np.log1p(len(raw)) / 10
    out[15] = len(raw) / n / 10
    out[16] = 1 - len(set(lines)) / max(1, len(lines))
    out[17] = np.log1p(n / max(1, len(lines))) / 5
    ends = sum(raw.count(c) for c in (b".", b"!", b"?"))
    out[18] = np.log1p(n / (1 + ends)) / 5
    out[19] = sum(map(bytes.isupper, words)) / n
    out[20] = sum(map(bytes.isalpha, words)) / n
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def worth(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.concatenate([z, z * z], axis=-1) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.worth(x) - self.threshold, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, worse_share: float, pairs: int = 40_000, steps: int = 300, l2: float = 1e-4, seed: int = 7) -> QualityModel:
    """Gradient descent with momentum on pairs drawn by seed. Without both classes: all score alike, by the class."""
    mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
    scale = (x.std(axis=0) if len(x) else np.zeros(N_FEATURES)) + 1e-6
    model = QualityModel(mean, np.maximum(scale, 1e-3), np.zeros(2 * N_FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        model.threshold = -2.0 if len(good) or not len(bad) else 2.0
        return model
    rng = np.random.default_rng(seed)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    z = np.concatenate([z, z * z], axis=1)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, v = model.weights, np.zeros(2 * N_FEATURES)
    for _ in range(steps):
        g = -(d / (1 + np.exp(np.clip(d @ w, -40, 40)))[:, None]).mean(axis=0) + l2 * w
        v = 0.9 * v - 0.05 * g
        w += v
    s = model.worth(x)
    share = np.where(y == 1, (1 - worse_share) / len(good), worse_share / len(bad))
    order = np.argsort(s, kind="stable")
    k = int(np.searchsorted(np.cumsum(share[order]), worse_share - 1e-9)) + 1  # as many lie below as hold that share
    k = min(max(k, 1), len(s) - 1)
    model.threshold = float((s[order[k - 1]] + s[order[k]]) / 2)
    return model


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t or "").tolist() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in rebatch(batches):
            x = np.array([features(t or "") for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            x = model.mean + np.clip((x - model.mean) / model.scale, -8, 8) * model.scale
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x)), pa.array(model.worth(x))], names=["doc_id", "score", "worth"])

    return run


class QualityRanker:
    """per_class: the documented bound of the learning sample, in documents of each label."""

    def __init__(self, per_class: int = 4000):
        self.per_class, self.model = per_class, None

    def fit(self, docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> QualityRanker:
        learn = F.lit(True) if learn is None else learn
        rows = labelled_sample(labels, "quality", learn, self.per_class)
        got = id_text(docs).join(F.broadcast(rows), "doc_id").select("doc_id", "text", "label").mapInArrow(_featurise, "doc_id long, label int, x array<double>").collect()
        got = sorted((r.doc_id, r.label, r.x) for r in got)
        x, y = np.array([g[2] for g in got]).reshape(-1, N_FEATURES), np.array([g[1] for g in got])
        share = labels.where(learn).agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0]
        self.model = train(x, y, share if share is not None else 0.5)
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score (0..1; at least 0.5 above the threshold), worth. Null and empty texts get the flag's score."""
        shared = docs.sparkSession.sparkContext.broadcast(self.model)
        return id_text(docs).mapInArrow(_apply(shared), "doc_id long, score double, worth double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract of op1: learn without the held-out rows, score every document.

    A row per row of docs, null ids (held out) and repeated rows included; equal texts have equal scores. Null, empty and blank texts get one score, that of
    a text without words; texts of any length are read whole. labels that are null or have a null id teach nothing, of an id's several labels
    the least counts; without labels of both kinds all documents score alike. An empty table gives an empty result; further columns are not read.
    """
    out = held_out(F.col("doc_id").cast("long"), 3, 1)
    scored = QualityRanker().fit(docs, labels, ~out).score(docs)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worth")
