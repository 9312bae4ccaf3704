"""Token counts of huge documents by overlap resynchronisation.

A document longer than a chunk is encoded in overlapping chunks with offsets. Two chunks are spliced
where both have a token border that is stable: a border between words of the vocabulary's split
pattern in both, and far enough from the first chunk's end that nothing cut off there can move it.
The pattern matches from left to right without looking back, so from a common border on both chunks
split alike, and the first is right up to there; hence the splice gives the whole text's tokens.
Without such a border the overlap widens; a chunk that is one word altogether grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, rebatch
from .tokenize import GPT_PATTERN, ByteBpe, byte_bpe

WORD = regex.compile(GPT_PATTERN)
GUARD = 4  # characters that a match can look ahead past its end, and one more


def borders(text: str) -> np.ndarray:
    """Ends of the words of a text in characters."""
    return np.fromiter((m.end() for m in WORD.finditer(text)), np.int64)


def token_ends(bpe: ByteBpe, text: str) -> np.ndarray:
    """Byte offsets where the tokens of a text end."""
    return np.cumsum(bpe.length[np.array(bpe.ordinary(text), np.int64)])


class Resync:
    """Counts and ids of texts without special strings, chunk by chunk: memory follows the chunk."""

    def __init__(self, bpe: ByteBpe, chunk: int = 16_384, overlap: int = 256):
        if not 0 < overlap < chunk:
            raise ValueError("overlap must be shorter than chunk")
        self.bpe, self.chunk, self.overlap, self.widened = bpe, chunk, overlap, 0

    def pieces(self, text: str) -> Iterator[list[int]]:
        """The ids of the text, in parts."""
        at, size, n = 0, self.chunk, len(text)  # at: a proven border
        while n - at > size:
            end, overlap = at + size, self.overlap
            a = text[at:end]
            ids = self.bpe.ordinary(a)
            ends = np.cumsum(self.bpe.length[np.array(ids, np.int64)])
            own = borders(a)
            own = own[own <= size - GUARD]
            while True:
                back = min(overlap, size)
                b = text[end - back : min(n, end + back)]  # enough of the next chunk to see its borders
                common = np.intersect1d(own, borders(b) + (size - back)) if back < size else own
                # a border at the overlap's first character is the next chunk's own start
                for p in common[::-1]:
                    k = int(np.searchsorted(ends, len(a[: int(p)].encode())))
                    nxt = token_ends(self.bpe, b)
                    q = int(p) - (size - back)
                    if ends[k] == len(a[: int(p)].encode()) and (q == 0 or len(b[:q].encode()) in nxt):
                        break
                else:
                    p = None
                if p is not None or back == size:
                    break
                overlap *= 4
                self.widened += 1
            if p is None:
                size *= 2
                continue
            yield ids[: k + 1]
            at, size = at + int(p), self.chunk
        yield self.bpe.ordinary(text[at:])

    def count(self, text: str) -> int:
        return len(self.bpe.ordinary(text)) if len(text) <= self.chunk else sum(map(len, self.pieces(text)))


def _count(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        sync = Resync(bpe, chunk, overlap)
        for b in rebatch(batches):
            texts = b.column(1)
            n = []
            for t in texts.to_pylist():
                parts = bpe.parts(t)
                n.append(sum(map(sync.count, parts)) + len(parts) - 1)
            size = pa.compute.binary_length(texts.cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.

    A null or empty text has 0 and 0; texts of any length are counted whole, in chunks. Repeated rows are counted as often as they come, a null id
    is carried through, no choice among ties arises. An empty table gives an empty result; further columns are not read.
    """
    got = id_text(docs).mapInArrow(_count(path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long")
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
