"""Packing by order-preserving dynamic programming.

Documents keep their order. Windows of at most ``window`` tokens are cut at document borders,
sentence borders, or, where those are far apart, word borders; the cuts minimise padding plus a
penalty for each kind of border. With f(j) the least cost up to border j at position x_j,

    f(j) = window - x_j + penalty(j) + min over i with x_j - x_i <= window of (f(i) + x_i),

so the minimum slides over the borders and a monotone queue keeps it in constant time each.
Each task packs the documents of its own input split: nothing is shuffled.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, rebatch, tidy
from .tokenize import word_bpe

SENTENCE, WORD_CUT = 24.0, 96.0  # penalties, in padding tokens
GAP = 64  # tokens between borders at most, where words allow it
BLOCK = 1 << 20  # tokens packed at once


def cut_points(x: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the borders chosen. x: ascending positions, x[0] = 0, steps of at most window; the last is a cut."""
    xs, pen = x.tolist(), penalty.tolist()
    n = len(xs)
    best, came = [0.0] * n, [0] * n
    queue = deque([(0.0, 0, 0)])  # (f + x, x, index), ascending
    for j in range(1, n):
        at = xs[j]
        low = at - window
        while queue[0][1] < low:
            queue.popleft()
        g, _, came[j] = queue[0]
        best[j] = f = g + window - at + pen[j]
        g = f + at
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, at, j))
    out = [n - 1]
    while out[-1]:
        out.append(came[out[-1]])
    return np.array(out[::-1])


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted and distinct, by a sort."""
    x = np.sort(x, kind="stable")
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def borders(lens: np.ndarray, stop: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties of the borders of a block of words.

    lens, stop: tokens of each word; it ends a sentence. docs: positions where documents end.
    """
    ends = np.cumsum(lens)
    total = int(docs[-1])
    words = _distinct(ends[lens > 0])
    at = _distinct(np.concatenate([[0], ends[stop & (lens > 0)], docs]))
    gap = np.flatnonzero(np.diff(at) > GAP)
    extra = [at]
    if len(gap):
        lo, hi = at[gap], at[gap + 1]
        count = (hi - lo - 1) // (GAP // 2)
        want = np.repeat(lo, count) + (GAP // 2) * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1)
        if len(words) and len(want):
            extra.append(words[np.minimum(np.searchsorted(words, want), len(words) - 1)])
    x = _distinct(np.concatenate(extra))
    while len(wide := np.flatnonzero(np.diff(x) > window)):  # within one word: cut anywhere
        x = np.sort(np.concatenate([x, x[wide] + window]))
    pen = np.full(len(x), WORD_CUT)
    pen[np.isin(x, at, assume_unique=True)] = SENTENCE
    pen[np.isin(x, docs)] = 0.0
    return x[x <= total], pen[x <= total]


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, width int"


class DpPacker:
    """A task's packer. Rows of documents in, pieces out; see ``pack``."""

    def __init__(self, path: str, window: int, end_id: int, task: int):
        self.bpe, self.window, self.end_id, self.seq = word_bpe(path), window, end_id, task << 40
        self.docs: list = []  # (doc_id, ids, lens, stop, first token not yet packed)
        self.held = 0

    def add(self, ids: list, texts: list[bytes]) -> Iterator[list[tuple]]:
        tokens, per, lens, stop = self.bpe.encode(texts)
        words = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
        a = w = 0
        for i, n, k in zip(ids, per, words, strict=True):
            t = np.append(tokens[a : a + n], np.uint32(self.end_id)).astype("<u4")
            self.docs.append((i, t, np.append(lens[w : w + k], 1), np.append(stop[w : w + k], False), 0))
            self.held += len(t)
            a, w = a + n, w + k
            if self.held >= BLOCK:
                yield self._flush(last=False)

    def _flush(self, last: bool) -> list[tuple]:
        """Packs what is held. Unless last, the final window's documents stay for the next block."""
        lens, stop, ends, at = [], [], [], 0
        for _, t, k, s, first in self.docs:
            end = np.cumsum(k)
            k = np.minimum(end, len(t)) - np.maximum(np.minimum(end - k, len(t)), first)
            lens.append(np.maximum(k, 0))
            stop.append(s)
            at += len(t) - first
            ends.append(at)
        docs = np.array(ends, np.int64)
        x, pen = borders(np.concatenate(lens), np.concatenate(stop), docs, self.window)
        cuts = x[cut_points(x, pen, self.window)]
        if last:  # the rest goes into full powers of two: no padding there
            rest, at = int(cuts[-1] - cuts[-2]), int(cuts[-2])
            cuts = cuts[:-1].tolist()
            while rest:
                step = 1 << (rest.bit_length() - 1)
                at, rest = at + step, rest - step
                cuts.append(at)
            cuts = np.array(cuts)
            stay = int(cuts[-1])
        else:
            stay = int(cuts[-2])
            cuts = cuts[:-1]
        out, kept, c, begin = [], [], 0, 0
        for i, t, k, s, first in self.docs:
            end, at = begin + len(t) - first, begin
            while at < min(end, stay):
                while cuts[c + 1] <= at:
                    c += 1
                to = min(end, int(cuts[c + 1]))
                lo = first + at - begin
                out.append((i, lo, to - at, t[lo : lo + to - at].tobytes(), len(t), self.seq + c, at - int(cuts[c]), int(cuts[c + 1] - cuts[c])))
                at = to
            if end > stay:
                kept.append((i, t, k, s, first + max(0, stay - begin)))
            begin = end
        self.seq += len(cuts) - 1
        self.docs, self.held = kept, begin - stay
        return out

    def rest(self) -> list[tuple]:
        return self._flush(last=True) if self.docs else []


def _pack(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = DpPacker(path, window, end_id, TaskContext.get().partitionId())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = [c.split()[0] for c in PIECES.split(", ")]

        def out(rows):
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], names=names)

        for b in rebatch(batches, 64):
            for rows in p.add(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                yield from out(rows)
        yield from out(p.rest())
        p.bpe.reset()

    return tidy(run)


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> a row per piece: doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset, width (tokens of the sequence).

    Each document is its text's ids and end_id; a null or empty text is end_id alone. Every id is
    in exactly one piece. Repeated rows are packed as often as they come. A task's last sequences
    are powers of two wide, all others at most ``window``, to which they are padded.
    """
    return id_text(docs).mapInArrow(_pack(path, window, end_id), PIECES)


def pieces(packed: DataFrame) -> DataFrame:
    """The digest of op6: ids as their crc32."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
