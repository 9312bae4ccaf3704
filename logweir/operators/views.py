"""Read views over the log: watermarks, lookups, fetches, committed reads, truncation, lag."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import stamp_all
from ..functions.prefix import exclusive_sum
from .loglayer import BLOCK_OBJECTS, KEYS

RANGE = 256  # offsets of a bucket in range joins


def high_watermark(bat: DataFrame) -> DataFrame:
    return bat.groupBy(*KEYS).agg(F.max(F.col("base_offset") + F.col("record_count")).alias("hw"))


def with_absent(topics: DataFrame, view: DataFrame, column: str) -> DataFrame:
    """A view's column for each partition of each topic (topic, partitions), 0 where it has no row."""
    parts = topics.select("topic", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("part"))
    return parts.join(view, KEYS, "left").select(*KEYS, F.coalesce(F.col(column), F.lit(0)).cast("long").alias(column))


def log_start_offset(bat: DataFrame, truncations: DataFrame) -> DataFrame:
    """First retained offset: the greatest truncation (topic, part, off) of a partition, else 0."""
    cut = truncations.groupBy(*KEYS).agg(F.max("off").alias("cut"))
    parts = bat.select(*KEYS).distinct()
    return parts.join(cut, KEYS, "left").select(*KEYS, F.coalesce("cut", F.lit(0)).cast("long").alias("log_start"))


def index_lookup(bat: DataFrame, off: int) -> DataFrame:
    """Entries that hold offset ``off`` or later ones."""
    return bat.where(F.col("base_offset") + F.col("record_count") > off)


def fetch(bat: DataFrame, off: int, max_bytes: int) -> DataFrame:
    """Batches from ``off`` on, as many as the byte budget holds; the first comes in any case.

    A negative budget is 0. ``run`` is the bytes up to and with the batch.
    """
    d = exclusive_sum(index_lookup(bat, off), KEYS, ["base_offset"], F.col("byte_len"), F.floor(F.col("commit_seq") / BLOCK_OBJECTS), "before")
    d = d.withColumn("run", F.col("before") + F.col("byte_len"))
    return d.where((F.col("run") <= max(0, max_bytes)) | (F.col("before") == 0)).drop("before")


def fetch_payload(entries: DataFrame, objects: DataFrame, off: int, max_bytes: int) -> DataFrame:
    """A read from ``off``: of each partition the batches that ``fetch`` takes, cut out of their objects, every record batch in
    them stamped with its offset, joined in order: topic, part, payload, next_offset. Past the high watermark there is no row.

    entries: the index with byte_start; objects (commit_seq, data): a row per object. A budget bounds what a partition's row holds.
    """
    hit = fetch(entries, off, max_bytes).join(objects, "commit_seq")
    cut = F.expr("substring(data, CAST(byte_start + 1 AS INT), CAST(byte_len AS INT))")
    hit = hit.select(*KEYS, "base_offset", "record_count", cut.alias("payload")).mapInArrow(_stamp, "topic string, part int, base_offset long, record_count long, payload binary")
    g = hit.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("base_offset", "payload"))).alias("all"), F.max(F.col("base_offset") + F.col("record_count")).alias("next_offset"))
    return g.select(*KEYS, F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["payload"])), "")).alias("payload"), "next_offset")


def _stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [stamp_all(p, o) for o, p in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)]
        yield b.set_column(4, "payload", pa.array(data, pa.binary()))


def check_start(off: int, log_start: int) -> None:
    """A read below the first retained offset is an error, not an empty answer."""
    if off < log_start:
        raise ValueError(f"InvalidOffset: {off} is below the log start {log_start}")


def leader_epoch_ends(epochs: DataFrame, hw: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (topic, part, epoch) -> end_epoch, end_offset: the greatest epoch that is not above the asked one, and where it ends,
    which is the next one's start or the high watermark. epochs (topic, part, epoch, start_offset). Unknown ones have -1 for both."""
    nxt = F.lead("start_offset").over(Window.partitionBy(*KEYS).orderBy("epoch"))
    e = epochs.withColumn("until", nxt).join(hw, KEYS, "left").select(*KEYS, F.col("epoch").alias("known"), F.coalesce("until", "hw").alias("until"))
    d = asked.join(e, [*[asked[k] == e[k] for k in KEYS], e.known <= asked.epoch], "left")
    m = d.groupBy(asked.topic, asked.part, asked.epoch).agg(F.max(F.struct("known", "until")).alias("m"))
    return m.select(*KEYS, "epoch", F.coalesce("m.known", F.lit(-1)).cast("int").alias("end_epoch"), F.coalesce("m.until", F.lit(-1)).cast("long").alias("end_offset"))


def list_offsets(rec: DataFrame, ts: str) -> DataFrame:
    """The first offset at or after a time, per partition."""
    return rec.where(F.col("ts") >= F.lit(ts).cast("timestamp_ntz")).groupBy(*KEYS).agg(F.min("off").alias("off"))


def truncate(bat: DataFrame, off: int) -> DataFrame:
    """What is left after truncation before ``off``; an entry across it stays. log_start only rises."""
    return bat.where(F.col("base_offset") + F.col("record_count") > off).withColumn("log_start", F.greatest(F.lit(0), F.lit(off)).cast("long"))


def truncate_strict(bat: DataFrame, log_start: int, hw: int, off: int) -> DataFrame:
    """As ``truncate``, for a caller that must not cut outside [log_start, hw]."""
    if not log_start <= off <= hw:
        raise ValueError(f"InvalidOffset: {off} is not in [{log_start}, {hw}]")
    return truncate(bat, off)


def aborted_lookup(st: DataFrame, off: int) -> DataFrame:
    """Aborted ranges that end at ``off`` or later; one per batch, both ends included."""
    last = (F.col("base_offset") + F.col("record_count") - 1).alias("last_offset")
    return st.where(F.col("state") == "aborted").select(*KEYS, "commit_seq", F.col("base_offset").alias("first_offset"), last).where(F.col("last_offset") >= off)


def read_committed(rec: DataFrame, st: DataFrame, pst: DataFrame) -> DataFrame:
    """Records below the last stable offset that no aborted range holds.

    Ranges are spread over offset buckets, so the anti join is an equi join with a residual: it
    scales with the ranges and needs no broadcast.
    """
    bad = aborted_lookup(st, 0).select(*KEYS, "first_offset", "last_offset")
    bad = bad.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first_offset") / RANGE), F.floor(F.col("last_offset") / RANGE))))
    r = rec.join(pst.select(*KEYS, "lso"), KEYS).where(F.col("off") < F.col("lso")).withColumn("bucket", F.floor(F.col("off") / RANGE))
    within = (r.topic == bad.topic) & (r.part == bad.part) & (r.bucket == bad.bucket) & r.off.between(bad.first_offset, bad.last_offset)
    return r.join(bad, within, "left_anti").select("event_id", *KEYS, "off")


def read_uncommitted(rec: DataFrame, pst: DataFrame) -> DataFrame:
    return rec.join(pst.select(*KEYS, "hw"), KEYS).where(F.col("off") < F.col("hw")).select("event_id", *KEYS, "off")


def lag(pst: DataFrame, committed: DataFrame) -> DataFrame:
    """High watermark less the group's committed offset."""
    return committed.join(pst, KEYS).select("grp", *KEYS, "hw", "committed", (F.col("hw") - F.col("committed")).alias("lag"))


def describe_topics(parts: DataFrame, leaders: DataFrame, hw: DataFrame, starts: DataFrame) -> DataFrame:
    """Every partition with its leader and epoch and the offsets it holds; 0 where nothing was written."""
    d = parts.join(leaders, KEYS, "left").join(hw, KEYS, "left").join(starts, KEYS, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return d.select(*KEYS, "leader", "leader_epoch", zero("hw"), zero("log_start"))


def log_dirs(bat: DataFrame) -> DataFrame:
    """Bytes and batches of each partition."""
    return bat.groupBy(*KEYS).agg(F.sum("byte_len").cast("long").alias("bytes"), F.count("*").alias("batches"))
