"""Streams: exactly-once commits by micro-batch, per-producer deduplication, event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import loglayer
from ..operators.loglayer import KEYS

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a directory, or of a single file."""
    r = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    if status.isFile():  # the source takes directories only
        return r.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return r.parquet(path)


MARKS = "topic STRING, part INT, hw BIGINT"


class CommitLog:
    """A log whose objects count once they have a mark: {log}/object=<stream>-<batch> and {log}/_marks/<n>-<stream>-<batch>.

    A mark is the small table of high watermarks after its object, written aside and renamed into place, so
    a commit is one rename, and the next one reads watermarks and not the log. Objects without a mark are what a lost writer
    left. A log has one writer at a time; streams may follow each other, each under a name of its own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._p("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def marks(self) -> list[str]:
        folder = self._p("_marks")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def objects(self) -> list[str]:
        return [m.split("-", 1)[1] for m in self.marks()]

    def watermarks(self) -> DataFrame:
        done = self.marks()
        return self.spark.read.schema(MARKS).parquet(f"{self.path}/_marks/{done[-1]}") if done else self.spark.createDataFrame([], MARKS)

    def read(self) -> DataFrame:
        """All committed records."""
        schema = "event_id BIGINT, user_id BIGINT, value DOUBLE, topic STRING, part INT, off BIGINT"
        paths = [f"{self.path}/object={o}" for o in self.objects()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, df: DataFrame, name: str) -> bool:
        """Numbers the events after what is committed. A name that is committed already changes nothing: False."""
        done = self.marks()
        if any(m.split("-", 1)[1] == name for m in done):
            return False
        rec = loglayer.numbered(df, self.watermarks())
        rec.write.mode("overwrite").parquet(f"{self.path}/object={name}")
        rec = self.spark.read.schema(rec.schema).parquet(f"{self.path}/object={name}")
        top = rec.groupBy(*KEYS).agg((F.max("off") + 1).alias("top"))
        hw = self.watermarks().join(top, KEYS, "full").select(*KEYS, F.coalesce("top", "hw").cast("long").alias("hw"))
        aside = f"_aside-{uuid.uuid4().hex}"
        hw.coalesce(1).write.parquet(f"{self.path}/{aside}")
        self.fs.mkdirs(self._p("_marks"))
        if not self.fs.rename(self._p(aside), self._p(f"_marks/{len(done):012d}-{name}")):
            raise RuntimeError(f"the commit of {name} could not be marked")
        return True


def commit_to(log: str, stream: str | None = None):
    """For ``foreachBatch``: a micro-batch is one object of a CommitLog, named by its stream and batch id, so a batch that is
    run again is committed once and another query's batches never replace it. stream: by default the query's id, which its checkpoint keeps."""

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        name = stream or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise ValueError("outside a streaming query a stream name is needed")
        e = df.select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part"), "event_id", "user_id", "value")
        CommitLog(spark, log).commit(e, f"{name}-{batch_id:012d}")

    return run


def deduplicate(batches: DataFrame, remembered: int = 5) -> DataFrame:
    """Stream of batches -> outcomes by producer, topic and partition: Assigned, Duplicate, stale or out of order.

    State is bounded: the epoch, the next sequence and the last accepted batches. Rows of a trigger
    are taken in commit order.
    """
    schema = "commit_seq BIGINT, producer_id BIGINT, topic STRING, partition INT, base_sequence INT, outcome STRING"
    state = "epoch INT, next_seq BIGINT, recent ARRAY<INT>"

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        epoch, nxt, recent = held.get if held.exists else (-1, 0, [])
        recent, rows = list(recent), []
        for b in pd.concat(list(parts)).sort_values(["commit_seq", "batch_idx"]).itertuples():
            if b.producer_epoch == epoch and b.base_sequence in recent:
                what = "Duplicate"
            elif b.producer_epoch < epoch:
                what = "InvalidProducerEpoch"
            elif b.base_sequence != (nxt if b.producer_epoch == epoch else 0):
                what = "OutOfOrderSequence"
            else:
                if b.producer_epoch > epoch:
                    recent = []
                what, epoch, nxt = "Assigned", int(b.producer_epoch), int(b.base_sequence) + int(b.record_count)
                recent = [*recent, int(b.base_sequence)][-remembered:]
            rows.append((b.commit_seq, *key, b.base_sequence, what))
        held.update((epoch, nxt, recent))
        yield pd.DataFrame(rows, columns=["commit_seq", "producer_id", "topic", "partition", "base_sequence", "outcome"])

    return batches.groupBy("producer_id", "topic", "partition").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def _times(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; event time, so the session's zone should be UTC."""
    g = _times(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per overlapping window and type."""
    g = _times(events, late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user."""
    g = _times(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is available, into a memory table: for tests and small reports."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame, folder: str) -> DataFrame:
    """All that is available, appended to Parquet files below the folder, next to the checkpoint: windows come once they are closed."""
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")
