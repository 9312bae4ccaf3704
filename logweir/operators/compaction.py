"""Retention and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .loglayer import KEYS


def keep_latest(rec: DataFrame, key: str) -> DataFrame:
    """A compacted topic: the last offset of each key."""
    return rec.groupBy(*KEYS, key).agg(F.max("off").alias("off"))


def latest_records(rec: DataFrame, key: str) -> DataFrame:
    """The whole last record of each key."""
    rest = [c for c in rec.columns if c not in (*KEYS, key, "off")]
    m = rec.groupBy(*KEYS, key).agg(F.max(F.struct("off", *rest)).alias("m"))
    return m.select(*KEYS, key, "m.off", *[f"m.{c}" for c in rest])


def retention_by_time(rec: DataFrame, hours: int) -> DataFrame:
    """Truncation point of each partition: past its last record older than the limit, counted from its newest."""
    newest = rec.groupBy(*KEYS).agg(F.max("ts").alias("newest"))
    old = rec.join(newest, KEYS).where(F.col("ts") < F.col("newest") - F.expr(f"INTERVAL {int(hours)} HOURS"))
    cut = old.groupBy(*KEYS).agg((F.max("off") + 1).alias("cut"))
    return newest.select(*KEYS).join(cut, KEYS, "left").select(*KEYS, F.coalesce("cut", F.lit(0)).cast("long").alias("log_start"))


def retention_by_size(bat: DataFrame, max_bytes: int) -> DataFrame:
    """Truncation point that leaves the newest batches within the budget; the newest one always stays."""
    from ..functions.prefix import exclusive_sum
    from .loglayer import BLOCK_OBJECTS

    d = exclusive_sum(bat, KEYS, ["base_offset"], F.col("byte_len"), F.floor(F.col("commit_seq") / BLOCK_OBJECTS), "before")
    total = bat.groupBy(*KEYS).agg(F.sum("byte_len").alias("total"), F.max("base_offset").alias("newest"))
    keep = d.join(total, KEYS).where((F.col("total") - F.col("before") <= max_bytes) | (F.col("base_offset") == F.col("newest")))
    return keep.groupBy(*KEYS).agg(F.min("base_offset").alias("log_start"))


def compact_files(spark: SparkSession, source: str, target: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrites a log directory into few, offset-sorted files per partition."""
    rec = spark.read.parquet(source)
    d = rec.repartition("topic", "part", F.floor(F.col("off") / rows_per_file)).sortWithinPartitions("topic", "part", "off")
    d.write.option("maxRecordsPerFile", rows_per_file).partitionBy("topic", "part").mode("errorifexists").parquet(target)
