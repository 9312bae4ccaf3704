"""The log layer: records, batches, index and states derived from a table of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.prefix import exclusive_sum

KEYS = ["topic", "part"]
OBJECT_EVENTS = 64
BLOCK_OBJECTS = 256


def records(events: DataFrame) -> DataFrame:
    """events -> event_id, topic, part, user_id, ts, value, off, commit_seq, nbytes.

    Offsets are a batch's base and the place in the batch: the windows never span more than one
    object, and bases are a blocked running sum, so a hot partition is not one task.
    """
    e = events.select(
        "event_id", F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part"), "user_id", "ts", "value",
        F.floor(F.col("event_id") / OBJECT_EVENTS).cast("long").alias("commit_seq"), (F.length("props") + 28).cast("long").alias("nbytes"),
    )
    n = e.groupBy(*KEYS, "commit_seq").agg(F.count("*").alias("n"))
    n = exclusive_sum(n, KEYS, ["commit_seq"], F.col("n"), F.floor(F.col("commit_seq") / BLOCK_OBJECTS), "base").drop("n")
    place = Window.partitionBy(*KEYS, "commit_seq").orderBy("event_id")
    e = e.withColumn("place", F.row_number().over(place)).join(n, [*KEYS, "commit_seq"])
    return e.select("event_id", "topic", "part", "user_id", "ts", "value", (F.col("base") + F.col("place") - 1).cast("long").alias("off"), "commit_seq", "nbytes")


def numbered(events: DataFrame, marks: DataFrame) -> DataFrame:
    """events (topic, part, event_id, ...) with offsets after the high watermarks marks (topic, part, hw), by event_id."""
    block = F.floor(F.col("event_id") / (OBJECT_EVENTS * BLOCK_OBJECTS))
    d = exclusive_sum(events, KEYS, ["event_id"], F.lit(1), block, "off").join(marks, KEYS, "left")
    return d.withColumn("off", (F.coalesce("hw", F.lit(0)) + F.col("off")).cast("long")).drop("hw")


def batches(rec: DataFrame) -> DataFrame:
    """One batch for each object, topic and partition: base offset, count, bytes."""
    return rec.groupBy("commit_seq", *KEYS).agg(F.min("off").alias("base_offset"), F.count("*").alias("record_count"), F.sum("nbytes").cast("long").alias("byte_len"))


def event_batches(events: DataFrame) -> DataFrame:
    """``batches(records(events))`` without numbering each record."""
    e = events.groupBy(F.floor(F.col("event_id") / OBJECT_EVENTS).cast("long").alias("commit_seq"), F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part"))
    n = e.agg(F.count("*").alias("record_count"), F.sum(F.length("props") + 28).cast("long").alias("byte_len"))
    n = exclusive_sum(n, KEYS, ["commit_seq"], F.col("record_count"), F.floor(F.col("commit_seq") / BLOCK_OBJECTS), "base_offset")
    return n.select("commit_seq", *KEYS, "base_offset", "record_count", "byte_len")


def with_state(bat: DataFrame) -> DataFrame:
    """The synthetic transaction state: the last object is open, one in seven aborted."""
    last = bat.agg(F.max("commit_seq").alias("last"))
    state = F.when(F.col("commit_seq") == F.col("last"), "open").when(F.col("commit_seq") % 7 == 3, "aborted").otherwise("committed")
    return bat.join(F.broadcast(last)).withColumn("state", state).drop("last")  # one row


def partition_state(st: DataFrame) -> DataFrame:
    """High watermark and last stable offset of each partition."""
    hw = F.max(F.col("base_offset") + F.col("record_count")).alias("hw")
    first = F.min(F.when(F.col("state") == "open", F.col("base_offset"))).alias("first_open")
    return st.groupBy(*KEYS).agg(hw, first).select(*KEYS, "hw", F.coalesce("first_open", "hw").alias("lso"))


def object_index(bat: DataFrame) -> DataFrame:
    """Index entries with their end, so that range filters are plain comparisons that reach the scan."""
    end = (F.col("base_offset") + F.col("record_count")).alias("end_offset")
    return bat.select(*KEYS, "commit_seq", "base_offset", "record_count", "byte_len", end)


def object_key(host: Column, pid: Column, counter: Column, nanos: Column) -> Column:
    """Prefix of an object's key; characters that keys cannot hold become dashes."""
    clean = F.regexp_replace(host, "[^A-Za-z0-9._-]", "-")
    return F.concat(F.lit("seg/"), F.concat_ws("-", clean, pid.cast("string"), counter.cast("string"), nanos.cast("string")), F.lit("/"))


def write_log(rec: DataFrame, path: str) -> None:
    """Parquet by topic and partition, sorted by offset in each file: row groups prune by offset."""
    rec.repartition("topic", "part", F.floor(F.col("off") / 1_000_000)).sortWithinPartitions("topic", "part", "off").write.partitionBy("topic", "part").mode("append").parquet(path)
