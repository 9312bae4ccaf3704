"""Checks and figures over a consumed log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import payload
from ..functions.fnv import BASIS_HI, BASIS_LO, big_endian_32, big_endian_64, constant, fnv1a, hex64, limbs, rotate_left, xor
from ..functions.prefix import STEP, numbered, previous
from .loglayer import KEYS


def contiguity(rec: DataFrame) -> DataFrame:
    """Per partition: the count equals the span of offsets."""
    g = rec.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("off").alias("lo"), F.max("off").alias("hi"))
    return g.withColumn("contiguous", F.col("n") == F.col("hi") - F.col("lo") + 1)


def no_lost_writes(consumed: DataFrame, acked: DataFrame) -> DataFrame:
    """consumed and acked (topic, part, n, lo, hi / acked): duplicates are allowed, gaps and losses are not."""
    d = consumed.join(acked, KEYS, "full")
    return d.select(*KEYS, F.coalesce("n", F.lit(0)).alias("n"), "acked", (F.coalesce("n", F.lit(0)) >= F.col("acked")).alias("complete"), (F.col("n") < F.col("hi") - F.col("lo") + 1).alias("gap"))


def exactly_once(consumed: DataFrame, acked: DataFrame) -> DataFrame:
    d = consumed.join(acked, KEYS, "full")
    return d.select(*KEYS, ((F.col("n") == F.col("acked")) & (F.col("n") == F.col("hi") - F.col("lo") + 1)).alias("exact"))


def replay_proof(seen: DataFrame, expected: DataFrame) -> DataFrame:
    """seen (key, seq, place) against expected (key, n): what went wrong, per row.

    duplicate: a sequence again; gap: it does not follow its predecessor; unexpected: at or past n;
    missing: never seen.
    """
    w = Window.partitionBy("key", "seq").orderBy("place")
    d = seen.join(expected, "key", "left")
    dup = d.withColumn("rn", F.row_number().over(w)).where("rn > 1").select("key", "seq", F.lit("duplicate").alias("kind"))
    bad = d.where("n IS NULL OR seq < 0 OR seq >= n").select("key", "seq", F.lit("unexpected").alias("kind"))
    missing = numbered(expected, "n", "seq").select("key", "seq").join(seen, ["key", "seq"], "left_anti").select("key", "seq", F.lit("missing").alias("kind"))
    prev = previous(seen.select("key", "seq", "place"), ["key"], ["seq", "place"], F.col("seq"), F.floor(F.col("seq") / STEP), "prev")
    gap = prev.where("seq > prev + 1").select("key", "seq", F.lit("gap").alias("kind"))
    return dup.unionAll(bad).unionAll(missing).unionAll(gap)


def replay_records(consumed: DataFrame, acked: DataFrame, size: int, partitions: int) -> DataFrame:
    """consumed (part, off, key, value) against acked (part, n): the first fault of each faulty record, and keys never seen.

    In this order: invalid_key, invalid_value, partition outside 0 to partitions - 1, partition_mismatch and
    sequence_mismatch of key and value, unacknowledged, duplicate, and of what is left offset_gap (it
    does not follow the partition's last sound record), seed_mismatch, payload_mismatch. missing rows have a null off.
    """
    c = consumed.join(acked.withColumnRenamed("part", "_p"), F.col("part") == F.col("_p"), "left").drop("_p")
    c = c.withColumn("k", payload.parse_key(F.col("key"))).withColumn("v", payload.parse_value(F.col("value")))
    fault = (
        F.when(F.col("k").isNull(), "invalid_key").when(F.col("v").isNull(), "invalid_value").when(~F.col("part").between(0, partitions - 1), "unknown_partition")
        .when((F.col("k.part") != F.col("part")) | (F.col("v.part") != F.col("part")), "partition_mismatch").when(F.col("v.seq") != F.col("k.seq"), "sequence_mismatch")
        .when((F.col("k.seq") < 0) | (F.col("k.seq") >= F.coalesce("n", F.lit(0))), "unacknowledged")
    )
    c = c.withColumn("kind", fault)
    sound = c.where("kind IS NULL").select("part", "off", F.col("k.seq").alias("seq"), F.col("v.seed").alias("seed"), "value")
    again = F.row_number().over(Window.partitionBy("part", "seq").orderBy("off")) > 1
    sound = sound.withColumn("again", again)
    once = previous(sound.where("NOT again").drop("again"), ["part"], ["off"], F.col("off"), F.floor(F.col("off") / STEP), "prev")
    want = payload.record_value(F.col("part"), F.col("seq"), size)
    once = once.withColumn("kinds", F.array_compact(F.array(
        F.when(F.col("off") != F.coalesce(F.col("prev") + 1, F.lit(0)), "offset_gap"), F.when(F.col("seed") != hex64(payload.seed(F.col("part"), F.col("seq"))), "seed_mismatch").when(F.col("value") != want, "payload_mismatch"),
    )))
    missing = numbered(acked, "n", "seq").select("part", "seq").join(sound.select("part", "seq"), ["part", "seq"], "left_anti")
    out = c.where("kind IS NOT NULL").select("part", "off", "kind").unionAll(sound.where("again").select("part", "off", F.lit("duplicate")))
    return out.unionAll(once.select("part", "off", F.explode("kinds"))).unionAll(missing.select("part", F.lit(None).cast("long"), F.lit("missing")))


def nearest_rank(df: DataFrame, by: str, value: str, tie: str, p: float, blocks: int = 64) -> DataFrame:
    """The row at zero-based rank floor(p (n - 1) + 0.5) by value, exactly.

    Approximate quantiles cut each key's values into blocks; counts tell the block that holds the
    rank, and only that block is sorted, so a hot key is never one task's work.
    """
    marks = [i / blocks for i in range(1, blocks)]
    cuts = df.groupBy(by).agg(F.percentile_approx(value, marks, 10_000).alias("_cuts"), F.count("*").alias("_n"))
    d = df.select(by, value, tie).join(cuts, by)
    d = d.withColumn("_block", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))).drop("_cuts")
    g = d.groupBy(by, "_n", "_block").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("_before", before).withColumn("_rank", F.floor(F.lit(p) * (F.col("_n") - 1) + 0.5))
    g = g.where("_before <= _rank AND _rank < _before + _c").select(by, "_block", (F.col("_rank") - F.col("_before")).alias("_at"))
    one = d.join(g, [by, "_block"]).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(value, tie)) - 1)
    return one.where("_r = _at").select(by, value)


def flush_cost(bat: DataFrame) -> DataFrame:
    """Batches, records and bytes of each object."""
    return bat.groupBy("commit_seq").agg(F.count("*").alias("batches"), F.sum("record_count").cast("long").alias("records"), F.sum("byte_len").cast("long").alias("bytes"))


def cost_summary(bat: DataFrame) -> DataFrame:
    """Objects, records and bytes per object, writes per million records, batches per object, and the coalescing ratio, records per object."""
    s = flush_cost(bat).agg(F.count("*").alias("objects"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.sum("batches").alias("batches"))
    each = lambda c, name: (F.col(c) / F.col("objects")).alias(name)
    return s.select("objects", "records", each("bytes", "bytes_per_object"), (F.col("objects") * 1e6 / F.col("records")).alias("puts_per_million"), each("batches", "batches_per_object"), each("records", "coalescing"))


def index_tiling(bat: DataFrame) -> DataFrame:
    """Entries that do not start where their predecessor ends: none in a sound index."""
    end = F.col("base_offset") + F.col("record_count")
    d = previous(bat, KEYS, ["base_offset", "commit_seq"], end, F.floor(F.col("base_offset") / (16 * STEP)), "expected")
    return d.withColumn("expected", F.coalesce("expected", F.lit(0))).where("base_offset <> expected").select(*KEYS, "commit_seq", "base_offset", "expected")


def hw_agreement(views: DataFrame) -> DataFrame:
    """views (view, topic, part, hw): partitions with the number of different watermarks, and their sum."""
    g = views.groupBy(*KEYS).agg(F.countDistinct("hw").alias("different"), F.max("hw").alias("hw"))
    return g.agg(F.count("*").alias("partitions"), F.sum((F.col("different") > 1).cast("long")).alias("disagreeing"), F.sum("hw").cast("long").alias("total"))


def lso_monotonic(states: DataFrame) -> DataFrame:
    """states (step, topic, part, hw, lso): steps where the stable offset falls or passes the watermark."""
    w = Window.partitionBy(*KEYS).orderBy("step")
    return states.withColumn("prev", F.lag("lso").over(w)).where("lso < prev OR lso > hw").drop("prev")


def digest(rec: DataFrame, part: Column, seq: Column, value: Column) -> DataFrame:
    """Order-insensitive digest of each topic's partition: the basis xor the records' hashes.

    A record's hash runs over its partition (4 bytes), sequence (8) and value, and is rotated left by sequence mod 63, and 1.
    """
    h = rotate_left(fnv1a(F.concat(big_endian_32(part), big_endian_64(seq), value)), (seq % 63 + 1).cast("int"))
    x = rec.select(*KEYS, h.alias("h")).groupBy(*KEYS).agg(F.bit_xor("h.hi").alias("hi"), F.bit_xor("h.lo").alias("lo"))
    return x.select(*KEYS, hex64(xor(limbs(F.col("hi"), F.col("lo")), constant(BASIS_HI << 32 | BASIS_LO))).alias("digest"))


def expected_counts(spark, records: int, partitions: int) -> DataFrame:
    """An even split; what is left over goes to the low partitions."""
    p = spark.range(partitions)
    return p.select(F.col("id").cast("int").alias("part"), (F.lit(records // partitions) + (F.col("id") < records % partitions).cast("long")).alias("records"))


def equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two stores has, with multiplicity."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionAll(b.exceptAll(a).withColumn("side", F.lit("b")))
