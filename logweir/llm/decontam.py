"""Benchmark decontamination by the q-gram lemma.

If a window of w bytes of a benchmark item occurs in a document with at most e edits, the two share
w - q + 1 - e q q-grams or more, on diagonals that lie within e of each other. Shared q-grams are
counted in diagonal bands of width 2e that overlap by half, so one band sees them all; regions that
reach the bound are verified by a local alignment confined to the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, rebatch, tidy
from .near_dup import mix

Q = 8  # bytes: a q-gram is one 64-bit number
FILTER_BITS = 22
PENALTY = 3.0  # of an edit in alignments; a match counts 1
ORIGIN = 1 << 36  # added to diagonals, so that they are positive for texts of any length
WHOLE = 4096  # bytes of items that are aligned whole
EXPANDED = 1 << 21  # pairs of a document's and an item's position that are held at once


def normal(text: str) -> bytes:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split()).encode()


def qgrams(data: bytes) -> np.ndarray:
    n = len(data) - Q + 1
    return np.ndarray((n,), "<u8", data, strides=(1,)) if n > 0 else np.zeros(0, np.uint64)


@dataclass
class Items:
    """Benchmark items with an index of their q-grams. Items shorter than q bytes match nothing."""

    ids: list[int]
    texts: list[bytes]
    window: int
    rate: float

    def __post_init__(self):
        grams = [qgrams(t) for t in self.texts]
        g = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
        pos = np.concatenate([np.arange(len(x)) for x in grams] + [np.zeros(0, np.int64)])
        order = np.argsort(g, kind="stable")
        g, self.item, self.pos = g[order], item[order], pos[order]
        self.grams, self.first, self.count = np.unique(g, return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[mix(self.grams) >> np.uint64(64 - FILTER_BITS)] = True
        size = np.array([len(t) for t in self.texts], np.int64)
        self.w = np.minimum(size, self.window)
        self.e = np.floor(self.w * self.rate).astype(np.int64)
        self.least = np.maximum(1, self.w - Q + 1 - self.e * Q)
        self.half = int(self.e.max()) + 1 if len(size) else 1

    def regions(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(item, diagonal at the middle of the band, first and last position) that reach the lemma's bound."""
        g = qgrams(data)
        at = np.flatnonzero(self.filter[mix(g) >> np.uint64(64 - FILTER_BITS)]) if len(g) else g
        if not len(at) or not len(self.grams):
            return []
        k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        hit = self.grams[k] == g[at]
        at, k = at[hit], k[hit]
        if not len(at):
            return []
        ends = np.cumsum(self.count[k])
        if ends[-1] <= EXPANDED:
            return self._dense(at, k)
        out, start = [], 0
        reach = int(self.w.max() + self.e.max()) + Q  # a dense stretch is no longer
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + EXPANDED)))
            back = int(np.searchsorted(at, at[start] - reach))  # parts overlap by a stretch
            out += self._dense(at[back:stop], k[back:stop])
            start = stop
        return out

    def _dense(self, at: np.ndarray, k: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Of the document's positions at with the q-grams k: the regions."""
        n = self.count[k]
        i = np.repeat(at, n)
        j = np.repeat(self.first[k], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        item, diag = self.item[j], i - self.pos[j] + ORIGIN
        out = []
        for shift in (0, self.half):
            key = item * (1 << 40) + (diag + shift) // (2 * self.half)
            order = np.argsort(key, kind="stable")  # positions stay ascending within a key
            key, pos = key[order], i[order]
            ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
            starts = np.append(0, ends[:-1])
            it = item[order][starts]
            for s, e in zip(*(x[(ends - starts) >= self.least[it]] for x in (starts, ends)), strict=True):
                x, m = np.unique(pos[s:e]), int(item[order[s]])
                t = int(self.least[m])
                if len(x) < t:
                    continue
                dense = np.flatnonzero(x[t - 1 :] - x[: len(x) - t + 1] <= self.w[m] + self.e[m])
                if dense.size:
                    mid = int(key[s] % (1 << 40)) * 2 * self.half - shift + self.half - ORIGIN
                    runs = np.split(dense, np.flatnonzero(np.diff(x[dense]) > len(self.texts[m])) + 1)
                    out += [(m, mid, int(x[r[0]]), int(x[r[-1] + t - 1]) + Q) for r in runs]
        return out

    def verify(self, data: bytes, region: tuple[int, int, int, int]) -> tuple[int, int, int] | None:
        """(item, start, end) in the normal text if a local alignment is long and close enough."""
        m, mid, lo, hi = region
        a, reach = np.frombuffer(self.texts[m], np.uint8), 2 * self.half
        if len(a) > WHOLE:  # of a long item, what lies around the region
            margin = int(self.w[m]) + reach
            start, stop = max(0, lo - mid - margin), max(0, hi - mid + margin)
            a, mid = a[start:stop], mid + start
        lo, hi = max(0, min(lo, mid) - reach), min(len(data), max(hi, mid + len(a)) + reach)
        if (p := data.find(a.tobytes(), lo, hi)) >= 0:  # without edits the alignment is known
            return m, p, p + len(a)
        b = np.frombuffer(data, np.uint8)[lo:hi]
        score, ea, eb = banded(a, b, mid - lo, reach)
        w = int(self.w[m])
        if score < w * (1 - self.rate) - PENALTY * w * self.rate - 1e-9:
            return None
        back, sa, sb = banded(a[:ea][::-1], b[:eb][::-1], (eb - ea) - (mid - lo), reach)
        long = sa >= w * (1 - self.rate) - 1e-9
        return (m, lo + eb - sb, lo + eb) if long and back >= score - 1e-9 else None

    def found(self, text: str) -> list[tuple[int, int, int]]:
        data, best = normal(text), {}
        for r in self.regions(data):
            if v := self.verify(data, r):
                k = (v[0], v[1] // max(1, self.window))
                if k not in best or v[2] - v[1] > best[k][2] - best[k][1]:
                    best[k] = v
        return sorted(best.values(), key=lambda v: (v[1], self.ids[v[0]]))


def banded(a: np.ndarray, b: np.ndarray, mid: int, reach: int) -> tuple[float, int, int]:
    """Best local alignment of a and b on diagonals b - a within reach of mid: score, ends in a and b."""
    width = 2 * reach + 1
    step = PENALTY * np.arange(width)
    row, best = np.zeros(width), (0.0, 0, 0)
    offsets = np.arange(width) + mid - reach  # of b's index, less a's
    for i, x in enumerate(a.tolist()):
        j = offsets + i
        ok = (j >= 0) & (j < len(b))
        same = np.zeros(width, bool)
        same[ok] = b[j[ok]] == x
        new = np.where(ok, row + np.where(same, 1.0, -PENALTY), 0.0)
        new[:-1] = np.maximum(new[:-1], row[1:] - PENALTY)  # a's byte stands alone
        new = np.maximum(new, 0.0)
        new = np.where(ok, np.maximum.accumulate(new + step) - step, 0.0)  # b's bytes stand alone
        k = int(new.argmax())
        if new[k] > best[0]:
            best = (float(new[k]), i + 1, int(j[k]) + 1)
        row = new
    return best


FOUND = "doc_id long, contaminated boolean, item_ids array<long>, spans string"


def _find(shared):
    """Rows (doc_id, text), or those of FOUND and their text, with the findings of one more slice of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in rebatch(batches):
            got = [[(items.ids[m], s, e) for m, s, e in items.found(t)] for t in b.column(1).to_pylist()]
            if b.num_columns > 2:
                before = [[tuple(map(int, x.split(":"))) for x in t.split(",") if x] for t in b.column(4).to_pylist()]
                got = [sorted(x + g, key=lambda v: (v[1], v[0])) for x, g in zip(before, got, strict=True)]
            ids = [sorted({v[0] for v in g}) for g in got]
            spans = [",".join(f"{i}:{s}:{e}" for i, s, e in g) for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bool(g) for g in got], pa.bool_()), pa.array(ids, pa.list_(pa.int64())), pa.array(spans, pa.string())], names=["doc_id", "text", "contaminated", "item_ids", "spans"])

    return tidy(run)


def _drop_text(run):
    return lambda batches: (b.drop_columns(["text"]) for b in run(batches))


class Decontaminator:
    """window, rate: a passage of min(window, item) bytes with at most that share of edits counts.

    slice_bytes: benchmark text that is broadcast at once; a larger benchmark takes several passes
    over the documents, each with a slice below that size.
    """

    def __init__(self, window: int = 80, rate: float = 0.08, slice_bytes: int = 16 << 20):
        self.window, self.rate, self.slice_bytes = window, rate, slice_bytes

    def _slices(self, benchmark: DataFrame) -> Iterator[Items]:
        rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND length(text) > 0").distinct()
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(1, -(-2 * total // self.slice_bytes)) if total > self.slice_bytes else 1
        for k in range(n):
            part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
            got = sorted((r.item_id, r.text) for r in part.collect())
            yield Items([g[0] for g in got], [normal(g[1]) for g in got], self.window, self.rate)

    def find(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """A row per row of docs: contaminated, the items found, spans item:start:end in bytes of the normal text.

        Null and empty texts, and items shorter than q bytes, match nothing; neither do items with a null id or text. Repeated rows and
        null ids stay rows of their own. Findings of one passage by several items are all listed, by place and then by item id; items
        that repeat an id and a text count once. An empty benchmark finds nothing, an empty table gives an empty result, and further columns are not read.
        """
        spark = docs.sparkSession
        out, slices = id_text(docs), [spark.sparkContext.broadcast(i) for i in self._slices(benchmark)]
        for i in slices[:-1]:
            out = out.mapInArrow(_find(i), FOUND.replace(", ", ", text string, ", 1))
        return out.mapInArrow(_drop_text(_find(slices[-1])), FOUND)

    def clean(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """docs without the contaminated ones; all other rows (null and empty texts, repeated rows, null ids) and all columns stay."""
        out = docs
        for items in self._slices(benchmark):
            shared = docs.sparkSession.sparkContext.broadcast(items)
            out = out.mapInArrow(_keep(shared), docs.schema)
        return out


def _keep(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in rebatch(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([not items.found(t or "") for t in texts], pa.bool_()))

    return tidy(run)
