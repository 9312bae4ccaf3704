"""Transactions: resolution of produced ranges, staged offsets, epochs, fencing, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENDS = ("init", "commit", "abort")


def events_as_txn(events: DataFrame) -> DataFrame:
    """events -> seq, producer, kind, topic key: the synthetic transaction log."""
    kinds = {"signup": "init", "purchase": "commit", "error": "abort", "view": "produce", "click": "stage"}
    kind = F.lit(None).cast("string")
    for name, k in kinds.items():
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("producer"), kind.alias("kind"))


def _ends(txn: DataFrame) -> DataFrame:
    """Adds init_seq (latest init up to the row), term_seq and term (first end after it)."""
    back = Window.partitionBy("producer").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("producer").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    end = F.when(F.col("kind").isin(*ENDS), F.struct("seq", "kind"))
    t = txn.withColumn("init_seq", F.max(F.when(F.col("kind") == "init", F.col("seq"))).over(back)).withColumn("_end", F.min(end).over(ahead))
    return t.withColumn("term_seq", F.col("_end.seq")).withColumn("term", F.col("_end.kind")).drop("_end")


def resolve(txn: DataFrame, abort_on_reinit: bool = False) -> DataFrame:
    """State of each produced range: none, open, committed, aborted, or discarded by a new init
    (its records stay visible; with abort_on_reinit they count as aborted)."""
    lost = "aborted" if abort_on_reinit else "discarded"
    state = F.when(F.col("init_seq").isNull(), "none").when(F.col("term").isNull(), "open").when(F.col("term") == "init", lost).when(F.col("term") == "commit", "committed").otherwise("aborted")
    return _ends(txn).where(F.col("kind") == "produce").select("seq", "producer", state.alias("state"))


def apply_offsets(txn: DataFrame) -> DataFrame:
    """Staged offsets that commits made visible: of each key the latest by commit, then by stage.

    A stage outside a transaction is dropped. The key is the producer modulo 4.
    """
    s = _ends(txn).where((F.col("kind") == "stage") & F.col("init_seq").isNotNull() & (F.col("term") == "commit"))
    s = s.withColumn("key", (F.col("producer") % 4).cast("int"))
    return s.groupBy("key").agg(F.max(F.struct("term_seq", "seq")).alias("m")).select("key", F.col("m.term_seq").alias("term_seq"), F.col("m.seq").alias("seq"))


def epochs(txn: DataFrame) -> DataFrame:
    """Producer epochs: inits less one."""
    return txn.groupBy("producer").agg((F.count(F.when(F.col("kind") == "init", 1)) - 1).alias("epoch"))


def open_transactions(txn: DataFrame) -> DataFrame:
    """Producers whose latest end-type event is an init: what a listing of transactions shows."""
    last = txn.where(F.col("kind").isin(*ENDS)).groupBy("producer").agg(F.max(F.struct("seq", "kind")).alias("m"))
    return last.where(F.col("m.kind") == "init").select("producer", F.col("m.seq").alias("init_seq"))


def expired(txn: DataFrame, now: int, timeout: int) -> DataFrame:
    """Open transactions older than the timeout, in sequence numbers: to be aborted."""
    return open_transactions(txn).where(F.lit(now) - F.col("init_seq") > timeout)


def fence(txn: DataFrame) -> DataFrame:
    """Each produce with the epoch it was made under, and whether a later init of the producer fences it."""
    back = Window.partitionBy("producer").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum((F.col("kind") == "init").cast("int")).over(back) - 1
    t = txn.withColumn("epoch", at).join(epochs(txn).withColumnRenamed("epoch", "now"), "producer")
    return t.where(F.col("kind") == "produce").select("seq", "producer", F.col("epoch").cast("long").alias("epoch"), (F.col("epoch") < F.col("now")).alias("fenced"))


def ranges(txn: DataFrame, rec: DataFrame) -> DataFrame:
    """What commits record of open transactions: for each producer, transaction (its init) and partition the first and last offset
    and number of records produced in it, and how it ended. rec (event_id, topic, part, off) gives each produce its place."""
    t = _ends(txn).where((F.col("kind") == "produce") & F.col("init_seq").isNotNull())
    # an init is the latest one only if no end came after it: then the transaction is the open one at the produce
    last_end = F.max(F.when(F.col("kind").isin("commit", "abort"), F.col("seq"))).over(Window.partitionBy("producer").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    closed = txn.withColumn("end_seq", last_end).where("kind = 'produce'").select("seq", "end_seq")
    t = t.join(closed, "seq").where("end_seq IS NULL OR end_seq < init_seq")
    state = F.when(F.col("term").isNull(), "open").when(F.col("term") == "init", "discarded").when(F.col("term") == "commit", "committed").otherwise("aborted")
    r = rec.select(F.col("event_id").alias("seq"), "topic", "part", "off")
    g = t.withColumn("state", state).join(r, "seq").groupBy("producer", "init_seq", "topic", "part", "state")
    return g.agg(F.min("off").alias("first_offset"), F.max("off").alias("last_offset"), F.count("*").alias("records"))


def aborted_ranges(captured: DataFrame, off: int) -> DataFrame:
    """Aborted transactions that reach ``off`` or later, with their producer: what a committed read is told to skip."""
    return captured.where((F.col("state") == "aborted") & (F.col("last_offset") >= off)).select("producer", "topic", "part", "first_offset", "last_offset")


def markers(captured: DataFrame) -> DataFrame:
    """The control records that end transactions: one for each partition that an ended one wrote to, placed after its last record; type 1 commits, 0 aborts."""
    ended = captured.where(F.col("state").isin("committed", "aborted"))
    return ended.select("producer", "init_seq", "topic", "part", (F.col("last_offset") + 1).alias("after"), (F.col("state") == "committed").cast("int").alias("type"))


def fence_epochs(txn: DataFrame, commits: DataFrame) -> DataFrame:
    """commits (commit_seq, producer_id, seq) -> commit_seq, producer_id, epoch of the transaction that is open at seq: what fences batches below it."""
    marks = txn.where(F.col("kind").isin(*ENDS)).select(F.col("producer").alias("producer_id"), "seq", "kind", F.lit(None).cast("long").alias("commit_seq"))
    both = marks.unionByName(commits.select("producer_id", "seq", F.lit("ask").alias("kind"), "commit_seq"))
    w = Window.partitionBy("producer_id").orderBy("seq", F.col("kind") == "ask").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("kind") != "ask", F.struct("seq", "kind"))).over(w)
    at = (F.sum((F.col("kind") == "init").cast("int")).over(w) - 1).cast("int")
    d = both.withColumn("last", last).withColumn("epoch", at).where("kind = 'ask' AND last.kind = 'init'")
    return d.groupBy("commit_seq", "producer_id").agg(F.max("epoch").alias("epoch"))
