"""Flush policy: which arriving batches become one object.

A broker's buffer opens with its first batch and is written when the linger has passed, or when it
holds the byte or batch budget. A pause longer than the linger always empties the buffer, so the
batches between two pauses are a domain of their own: domains run in parallel, each as a stream of sorted rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.prefix import exclusive_sum, previous

CUTS = "broker int, seq long, spell long, within long"


@dataclass(frozen=True)
class FlushPolicy:
    """linger_us: longest wait of a buffer's first batch; 0 writes every batch by itself.
    max_inflight, max_buffered: objects that may be written at once, and bytes held before producers wait."""

    linger_us: int = 0
    max_bytes: int = 128 << 20
    max_batches: int = 1_000_000
    max_inflight: int = 4
    max_buffered: int = 512 << 20

    def stream_options(self) -> dict[str, str]:
        """The same limits for a stream that ingests: how long a trigger waits and what one may take."""
        return {"trigger": f"{max(1, self.linger_us // 1000)} milliseconds", "maxBytesPerTrigger": str(self.max_bytes), "maxRecordsPerFile": str(self.max_batches)}


def _cut(policy: FlushPolicy):
    """Rows (broker, spell, at, seq, bytes), sorted -> CUTS: the object's number within its spell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened, held, count, within = None, 0, 0, 0, 0
        for b in batches:
            out = []
            for broker, spell, at, seq, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (broker, spell) != key:
                    key, opened, held, count, within = (broker, spell), at, 0, 0, 0
                elif not count or at - opened >= policy.linger_us:
                    opened, held, count, within = at, 0, 0, within + 1
                out.append((broker, seq, spell, within))
                held, count = held + size, count + 1
                if held >= policy.max_bytes or count >= policy.max_batches:
                    count = 0  # written with this batch
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["broker", "seq", "spell", "within"])

    return run


def cut_objects(arrivals: DataFrame, policy: FlushPolicy) -> DataFrame:
    """arrivals (broker, seq, at: microseconds, bytes), at rising with seq -> broker, seq, object: numbered from 0 for each broker."""
    hour = F.floor(F.col("at") / 3_600_000_000)
    d = previous(arrivals, ["broker"], ["at", "seq"], F.col("at"), hour, "prev")
    opens = F.when(F.col("prev").isNull() | (F.col("at") - F.col("prev") >= max(1, policy.linger_us)), 1).otherwise(0)
    d = exclusive_sum(d.withColumn("opens", opens), ["broker"], ["at", "seq"], F.col("opens"), hour, "before")
    d = d.select("broker", (F.col("before") + F.col("opens") - 1).alias("spell"), "at", "seq", "bytes").repartition("broker", "spell").sortWithinPartitions("broker", "spell", "at", "seq")
    if policy.linger_us <= 0:
        cuts = d.select("broker", "seq", "spell", (F.row_number().over(Window.partitionBy("broker", "spell").orderBy("at", "seq")) - 1).cast("long").alias("within"))
    else:
        cuts = d.mapInArrow(_cut(policy), CUTS)
    size = cuts.groupBy("broker", "spell").agg((F.max("within") + 1).alias("n"))
    size = exclusive_sum(size, ["broker"], ["spell"], F.col("n"), F.floor(F.col("spell") / 65_536), "base").select("broker", "spell", "base")
    return cuts.join(size, ["broker", "spell"]).select("broker", "seq", (F.col("base") + F.col("within")).alias("object"))
