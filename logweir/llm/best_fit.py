"""Best-fit-decreasing packing with a segment tree over capacities.

Documents longer than a row are split losslessly: full rows first, the rest is a piece like others.
Pieces of a block are placed in order of falling length, each into the open row with the least room
that holds it. The rooms lie in a segment tree indexed by room: the search goes down from the
smallest room that fits, so each placement takes time in the logarithm of the row's width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, rebatch, tidy
from .tokenize import word_bpe

BLOCK = 1 << 20  # tokens packed at once


class RoomTree:
    """Rows by room 1..width; ``take(n)``: a row with the least room of n or more, or None."""

    def __init__(self, width: int):
        self.half = 1 << width.bit_length()
        self.count = [0] * (2 * self.half)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, room: int, d: int) -> None:
        i = room + self.half
        while i:
            self.count[i] += d
            i >>= 1

    def put(self, room: int, row: int) -> None:
        if room:
            self.rows[room].append(row)
            self._add(room, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        c, i = self.count, n + self.half
        if not c[i]:
            while i > 1 and (i & 1 or not c[i + 1]):  # up to the first subtree to the right with a row
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.half:
                i *= 2
                if not c[i]:
                    i += 1
        room = i - self.half
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], width: int) -> list[int]:
    """Row of each piece. Pieces of the same length keep their order; a length of 0 gets row 0."""
    out, tree, n = [0] * len(lengths), RoomTree(width), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = lengths[i]
        if not k:
            continue
        room, row = tree.take(k) or (width, n)
        n = max(n, row + 1)
        out[i] = row
        tree.put(room - k, row)
    return out


ROWS = "row_id long, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, ids binary"


def _pack(path: str, width: int, end_id: int, pad_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, number = word_bpe(path), TaskContext.get().partitionId() << 40
        schema = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary())])

        def flush(pieces):
            nonlocal number
            rows: dict[int, list] = {}
            for piece, r in zip(pieces, best_fit([len(p[2]) for p in pieces], width), strict=True):
                rows.setdefault(r, []).append(piece)
            out = []
            for r in sorted(rows):
                got = rows[r]
                ends = np.cumsum([len(p[2]) for p in got]).tolist()
                ids = np.full(width, pad_id, "<u4")
                ids[: ends[-1]] = np.concatenate([p[2] for p in got])
                out.append((number + r, ends[-1], [p[0] for p in got], [p[1] for p in got], [0, *ends], ids.tobytes()))
            number += len(rows)
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out[at : at + 256]], f.type) for i, f in enumerate(schema)], schema=schema)

        pieces, held = [], 0
        for b in rebatch(batches, 64):
            tokens, per, _, _ = bpe.encode(b.column(1).cast(pa.binary()).to_pylist())
            a = 0
            for i, n in zip(b.column(0).to_pylist(), per.tolist(), strict=True):
                t = np.append(tokens[a : a + n], np.uint32(end_id))
                a += n
                held += len(t)
                pieces += [(i, s, t[s : s + width]) for s in range(0, len(t), width)]
                if held >= BLOCK:
                    yield from flush(pieces)
                    pieces, held = [], 0
        if pieces:
            yield from flush(pieces)
        bpe.reset()

    return tidy(run)


def pack_rows(docs: DataFrame, path: str, width: int = 2048, end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """docs (doc_id, text, ...) -> packed rows: row_id, n_tokens, the documents of its segments and
    each segment's start in its document, cu_seqlens (cumulative segment lengths, from 0), ids
    (width little-endian unsigned 32-bit ids, padded).

    Each document is its text's ids and end_id; a null or empty text is end_id alone. Repeated
    rows are packed as often as they come. Each task packs the documents of its own input split in
    blocks of a bounded number of tokens: nothing is shuffled.
    """
    return id_text(docs).mapInArrow(_pack(path, width, end_id, pad_id), ROWS)


def with_positions(rows: DataFrame) -> DataFrame:
    """Adds position_resets: positions in the row where they start again from 0 (the segments' starts)."""
    return rows.withColumn("position_resets", F.slice("cu_seqlens", 1, F.size("cu_seqlens") - 1))


def write_rows(rows: DataFrame, path: str) -> None:
    """The id matrices with their segment lengths and resets, as Parquet."""
    with_positions(rows).write.parquet(path)


def positions(cu_seqlens: list[int], width: int) -> np.ndarray:
    """Position ids of a row: from 0 in each segment, 0 in the padding."""
    cu = np.array(cu_seqlens)
    out = np.zeros(width, np.int64)
    out[: cu[-1]] = np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))
    return out


def digest(rows: DataFrame) -> DataFrame:
    """A row per packed row, its ids as their crc32."""
    return with_positions(rows).select("row_id", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", "position_resets", F.crc32("ids").alias("ids_crc32"))
