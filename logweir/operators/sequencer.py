"""Commit sequencing: the all-or-nothing assignment of offsets to an object's batches.

Without idempotent batches offsets are a running sum (``commit_fast``). With them one rejected
object changes what later objects may do. Only producers carry that state, so ``commit_exact`` splits
the objects into domains that share no producer of a partition, folds each domain's batches in commit order
in a stream of sorted rows that holds one domain's state and one object, and then numbers what was accepted by
running sums in blocks: neither a domain nor a partition is ever one task's memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.graph import checkpointed, components
from ..functions.prefix import exclusive_sum

REMEMBERED = 5  # accepted batches whose retries are recognised
UNKNOWN, STALE, GAP = "UnknownTopicOrPartition", "InvalidProducerEpoch", "OutOfOrderSequence"


def commit_fast(batches: DataFrame) -> DataFrame:
    """Base offsets of batches none of which is idempotent: ordered by (commit_seq, batch_idx)."""
    return exclusive_sum(batches, ["topic", "partition"], ["commit_seq", "batch_idx"], F.col("record_count"), F.floor(F.col("commit_seq") / 256), "base_offset")


@dataclass
class Producer:
    epoch: int
    next_seq: int
    recent: deque = field(default_factory=lambda: deque(maxlen=REMEMBERED))


@dataclass
class LogState:
    """What commits read and change. partitions: known ones with their high watermark."""

    partitions: dict[tuple[str, int], int]
    producers: dict[tuple[int, str, int], Producer] = field(default_factory=dict)
    txn_epochs: dict[int, int] = field(default_factory=dict)

    def commit(self, batches: list[dict]) -> list[dict]:
        """Outcomes in input order. An error anywhere rejects the whole object and changes nothing."""
        bad = next(((None, UNKNOWN, None, None) for b in batches if (b["topic"], b["partition"]) not in self.partitions), None)
        ahead: dict[tuple, tuple[int, int]] = {}
        level: dict[tuple[str, int], int] = {}
        plan: list[tuple[str, int]] = []
        for i, b in enumerate(batches if bad is None else ()):
            tp, count = (b["topic"], b["partition"]), b["record_count"]
            if b["producer_id"] >= 0:
                key, epoch, seq = (b["producer_id"], *tp), b["producer_epoch"], b["base_sequence"]
                if epoch < self.txn_epochs.get(b["producer_id"], epoch):
                    bad = (i, STALE, None, None)
                    break
                known = self.producers.get(key)
                old = dict(known.recent).get(seq) if known and known.epoch == epoch else None
                if old is not None:
                    plan.append(("Duplicate", old))
                    continue
                at, want = ahead.get(key) or ((known.epoch, known.next_seq) if known else (epoch, 0))
                if epoch < at:
                    bad = (i, STALE, None, None)
                    break
                want = want if epoch == at else 0
                if seq != want:
                    bad = (i, GAP, want, seq)
                    break
                ahead[key] = (epoch, seq + count)
            base = level.get(tp, self.partitions[tp])
            plan.append(("Assigned", base))
            level[tp] = base + count
        if bad is not None:
            return [{"outcome": "Rejected", "base_offset": None, "error": bad[1], "expected": bad[2], "got": bad[3]} for _ in batches]
        self.partitions.update(level)
        for b, (what, base) in zip(batches, plan, strict=True):
            if what == "Assigned" and b["producer_id"] >= 0:
                key = (b["producer_id"], b["topic"], b["partition"])
                p = self.producers.get(key)
                if p is None or p.epoch < b["producer_epoch"]:
                    p = self.producers[key] = Producer(b["producer_epoch"], 0)
                p.next_seq = b["base_sequence"] + b["record_count"]
                p.recent.append((b["base_sequence"], base))
        return [{"outcome": w, "base_offset": o, "error": None, "expected": None, "got": None} for w, o in plan]


FOLDED = "commit_seq long, batch_idx int, object_id string, topic string, partition int, record_count int, outcome string, error string, expected long, got long, first_commit long, first_idx int"
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


class _Places(LogState):
    """Bases are the places (commit_seq, batch_idx) of batches: offsets follow once it is known which are accepted."""

    def __init__(self):
        super().__init__({})
        self.where: dict = {}
        self.held: dict = {}

    def commit_places(self, batches: list[dict]) -> list[tuple]:
        for b in batches:
            if b["known"]:
                self.partitions.setdefault((b["topic"], b["partition"]), 0)
            if b["fence_epoch"] is not None:
                self.txn_epochs[b["producer_id"]] = b["fence_epoch"]
            else:
                self.txn_epochs.pop(b["producer_id"], None)
        got = self.commit(batches)
        key = lambda b: (b["producer_id"], b["topic"], b["partition"])
        here = lambda b: (b["commit_seq"], b["batch_idx"])
        # retries first: what this object adds may push their originals out
        first = [self.where[key(b), b["base_sequence"]] if o["outcome"] == "Duplicate" else here(b) if o["outcome"] == "Assigned" else (None, None) for b, o in zip(batches, got, strict=True)]
        added = [b for b, o in zip(batches, got, strict=True) if o["outcome"] == "Assigned" and b["producer_id"] >= 0]
        for b in added:
            self.where[key(b), b["base_sequence"]] = here(b)
        for k in {key(b) for b in added}:
            kept = {q for q, _ in self.producers[k].recent}
            for q in self.held.get(k, set()) | {b["base_sequence"] for b in added if key(b) == k}:
                if q not in kept:
                    self.where.pop((k, q), None)
            self.held[k] = kept
        return [(*here(b), b["object_id"], *key(b)[1:], b["record_count"], o["outcome"], o["error"], o["expected"], o["got"], *f) for b, o, f in zip(batches, got, first, strict=True)]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by domain, commit_seq, batch_idx -> FOLDED."""
    cols = [c.split() for c in FOLDED.split(", ")]
    domain, state, held, rows = None, None, [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], KINDS[k]) for i, (_, k) in enumerate(cols)], names=[n for n, _ in cols])

    for b in batches:
        names = b.schema.names
        for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
            r = dict(zip(names, values, strict=True))
            if held and (held[0]["domain"], held[0]["commit_seq"]) != (r["domain"], r["commit_seq"]):
                rows += state.commit_places(held)
                held = []
            if state is None or r["domain"] != domain:
                domain, state = r["domain"], _Places()
            held.append(r)
        yield out()
        rows = []
    if held:
        rows += state.commit_places(held)
    yield out()


def domains(batches: DataFrame) -> DataFrame:
    """commit_seq -> domain: objects that share no producer of a partition, through any chain, differ.

    Objects without idempotent batches are domains of their own. Chains are followed only if some object has several producers.
    """
    key = F.concat_ws("/", F.col("producer_id").cast("string"), partition_key(F.col("topic"), F.col("partition")))
    idem = batches.where("producer_id >= 0").select("commit_seq", key.alias("key"))
    one = idem.groupBy("commit_seq").agg(F.min("key").alias("domain"), F.max("key").alias("other"))
    if not one.where("domain <> other").isEmpty():
        edges = idem.join(one, "commit_seq").where("key <> domain").select(F.col("domain").alias("a"), F.col("key").alias("b")).distinct()
        comps = components(edges).withColumnRenamed("node", "domain")
        one = one.join(comps, "domain", "left").withColumn("domain", F.coalesce("comp", "domain"))
    return one.select("commit_seq", "domain")


def commit_exact(batches: DataFrame, topics: DataFrame, fences: DataFrame | None = None) -> DataFrame:
    """Outcome of every batch: Assigned, Duplicate or Rejected, base offset, and what was wrong.

    batches as of BATCHES; topics (topic, partitions); fences (commit_seq, producer_id, epoch): the epoch of the
    producer's open transaction when the object was committed, below which batches are stale.
    """
    known = topics.select("topic", F.col("partitions").alias("_n"))
    b = batches.join(F.broadcast(known), "topic", "left").withColumn("known", F.coalesce(F.col("partition").between(0, F.col("_n") - 1), F.lit(False))).drop("_n")
    if fences is None:
        b = b.withColumn("fence_epoch", F.lit(None).cast("int"))
    else:
        b = b.join(fences.select("commit_seq", "producer_id", F.col("epoch").alias("fence_epoch")), ["commit_seq", "producer_id"], "left")
    b = b.join(domains(batches), "commit_seq", "left").withColumn("domain", F.coalesce("domain", F.concat(F.lit("plain/"), F.col("commit_seq").cast("string"))))
    rows = b.select("domain", "commit_seq", "batch_idx", "object_id", "topic", "partition", "producer_id", "producer_epoch", "base_sequence", "record_count", "known", "fence_epoch")
    rows = rows.repartition("domain").sortWithinPartitions("domain", "commit_seq", "batch_idx")
    d = checkpointed(rows.mapInArrow(_fold, FOLDED))  # folded once, read by each of the steps below
    assigned = exclusive_sum(d.where("outcome = 'Assigned'"), ["topic", "partition"], ["commit_seq", "batch_idx"], F.col("record_count"), F.floor(F.col("commit_seq") / 256), "base_offset")
    again = d.where("outcome = 'Duplicate'").join(assigned.select(F.col("commit_seq").alias("first_commit"), F.col("batch_idx").alias("first_idx"), "base_offset"), ["first_commit", "first_idx"], "left")
    bad = d.where("outcome = 'Rejected'").withColumn("base_offset", F.lit(None).cast("long"))
    cols = ["commit_seq", "batch_idx", "object_id", "topic", "partition", "outcome", "base_offset", "record_count", "error", "expected", "got"]
    return assigned.select(cols).unionAll(again.select(cols)).unionAll(bad.select(cols))


IDEMPOTENT = ["producer_id", "topic", "partition", "producer_epoch"]


def idempotent_dedup(batches: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """Retries of a batch, where batches do not depend on each other's rejection.

    A retry is recognised while its original is among the last ``remembered`` batches of the producer,
    partition and epoch, retries not counted. Batches without a producer (id -1) are never duplicates.
    """
    order = Window.partitionBy(*IDEMPOTENT).orderBy("commit_seq", "batch_idx")
    same = Window.partitionBy(*IDEMPOTENT, "base_sequence").orderBy("commit_seq", "batch_idx")
    d = batches.withColumn("_first", (F.row_number().over(same) == 1).cast("long"))
    d = d.withColumn("_place", F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = d.withColumn("_at", F.first("_place").over(same))
    late = (F.col("_first") == 0) & (F.col("_place") - F.col("_at") < remembered)
    return d.withColumn("duplicate", (F.col("producer_id") >= 0) & late).drop("_first", "_place", "_at")


def fencing(batches: DataFrame) -> DataFrame:
    """Batches whose epoch is below one seen earlier for the producer and partition; never those without a producer."""
    w = Window.partitionBy("producer_id", "topic", "partition").orderBy("commit_seq", "batch_idx").rowsBetween(Window.unboundedPreceding, -1)
    stale = F.coalesce(F.col("producer_epoch") < F.max("producer_epoch").over(w), F.lit(False))
    return batches.withColumn("fenced", (F.col("producer_id") >= 0) & stale)


def sequence_gap(batches: DataFrame) -> DataFrame:
    """Expected and got sequence of a producer's batches that do not follow their predecessor of the same epoch."""
    w = Window.partitionBy(*IDEMPOTENT).orderBy("commit_seq", "batch_idx")
    want = F.coalesce(F.lag(F.col("base_sequence").cast("long") + F.col("record_count")).over(w), F.lit(0).cast("long"))
    return batches.where("producer_id >= 0").withColumn("expected", want).where(F.col("base_sequence") != F.col("expected"))


def recent_batches(batches: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """Of each producer, partition and epoch the last distinct sequences by commit: what a retry is compared with."""
    last = batches.where("producer_id >= 0").groupBy(*IDEMPOTENT, "base_sequence").agg(F.min(F.struct("commit_seq", "batch_idx")).alias("at"))
    rank = F.row_number().over(Window.partitionBy(*IDEMPOTENT).orderBy(F.desc("at")))
    return last.withColumn("rank", rank).where(F.col("rank") <= remembered).select(*IDEMPOTENT, "base_sequence", F.col("at.commit_seq").alias("commit_seq"), "rank")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those rows of new whose key it lacks; of new rows with one key the least."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return existing.unionByName(once.join(existing.select(*keys), keys, "left_anti"))


def partition_key(topic, partition):
    return F.concat_ws("/", topic, partition.cast("string"))


def split_key(key):
    """The part before the last slash, and the number after it."""
    return F.struct(F.regexp_extract(key, "^(.*)/([0-9]+)$", 1).alias("topic"), F.regexp_extract(key, "^(.*)/([0-9]+)$", 2).cast("int").alias("partition"))
