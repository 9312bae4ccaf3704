"""Routing by hash: leaders, coordinators, key partitioning, peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fnv import big_endian_32, fnv1a, unsigned_mod
from ..functions.prefix import exclusive_sum
from ..schemas import BROKERS


def parse_peers(peers: DataFrame) -> DataFrame:
    """peer ``id@host:port`` -> node_id, host, port; the port follows the last colon."""
    part = lambda i: F.regexp_extract("peer", r"^(\d+)@(.+):(\d+)$", i)
    return peers.select(part(1).cast("int").alias("node_id"), part(2).alias("host"), part(3).cast("int").alias("port"))


def membership(brokers: list[tuple[int, str, int]], self_id: int | None = None) -> list[tuple[int, str, int]]:
    """Brokers by id. Ids are distinct, and one's own must be among them."""
    ids = [b[0] for b in brokers]
    if len(set(ids)) < len(ids):
        raise ValueError("a node id occurs twice")
    if self_id is not None and self_id not in ids:
        raise ValueError(f"node {self_id} is not in the peer list")
    return sorted(brokers)


def cluster(spark: SparkSession, brokers: list[tuple[int, str, int]], self_id: int, cluster_id: str) -> DataFrame:
    """A cluster's description: every broker, which one answers, and the controller, the smallest id."""
    d = spark.createDataFrame(membership(brokers, self_id), BROKERS)
    return d.withColumns({"cluster_id": F.lit(cluster_id), "is_self": F.col("node_id") == self_id, "is_controller": F.col("node_id") == min(b[0] for b in brokers)})


def leader_index(topic: Column, partition: Column, n: int) -> Column:
    """Place of the leader among n brokers sorted by id; null without brokers."""
    if not n:
        return F.lit(None).cast("int")
    return unsigned_mod(fnv1a(F.concat(topic.cast("binary"), big_endian_32(partition))), n).cast("int")


def coordinator_index(group: Column, n: int) -> Column:
    return unsigned_mod(fnv1a(group.cast("binary")), n).cast("int") if n else F.lit(None).cast("int")


def leader_for(parts: DataFrame, nodes: list[int]) -> DataFrame:
    """parts (topic, part) -> leader's node id."""
    ids = F.array(*[F.lit(i) for i in sorted(nodes)])
    return parts.select("topic", "part", F.element_at(ids, leader_index(F.col("topic"), F.col("part"), len(nodes)) + 1).alias("leader"))


def coordinator_for(groups: DataFrame, nodes: list[int]) -> DataFrame:
    ids = F.array(*[F.lit(i) for i in sorted(nodes)])
    return groups.select("grp", F.element_at(ids, coordinator_index(F.col("grp"), len(nodes)) + 1).alias("coordinator"))


def partition_leader(parts: DataFrame, registered: DataFrame, nodes: list[int], self_id: int) -> DataFrame:
    """parts (topic, part) -> leader and leader epoch: the registered owner (topic, part, owner, leader_epoch), else the one that the
    hash names, else, without any node, oneself; epochs of partitions that are not registered are 0."""
    r = parts.join(registered, ["topic", "part"], "left")
    ids = F.array(*[F.lit(i) for i in sorted(nodes)]) if nodes else None
    named = F.element_at(ids, leader_index(F.col("topic"), F.col("part"), len(nodes)) + 1) if nodes else F.lit(None).cast("int")
    return r.select("topic", "part", F.coalesce("owner", named, F.lit(self_id)).cast("int").alias("leader"), F.coalesce("leader_epoch", F.lit(0)).cast("int").alias("leader_epoch"))


def leader_balance(topic: DataFrame, nodes: list[int], partitions: int) -> DataFrame:
    """topic (topic) -> partitions led by each node, and whether that is more than 0 and less than three even shares."""
    parts = topic.select("topic", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("part"))
    led = leader_for(parts, nodes).groupBy("topic", "leader").agg(F.count("*").alias("led"))
    share = partitions / max(1, len(nodes))
    return led.withColumn("balanced", (F.col("led") > 0) & (F.col("led") < 3 * share))


def record_partition(records: DataFrame, n: int, explicit: str, key: str, order: str) -> DataFrame:
    """records with ``partition``: the explicit one if given, else by the key's hash, and without a key in turns, by order.

    Turns are counted in blocks of 65,536 of ``order``, so keyless records are no single task's.
    """
    turn = F.when(F.col(explicit).isNull() & F.col(key).isNull(), 1).otherwise(0)
    d = exclusive_sum(records, [], [order], turn, F.floor(F.col(order) / 65_536), "_turn")
    hashed = unsigned_mod(fnv1a(F.col(key).cast("string").cast("binary")), n)
    return d.withColumn("partition", F.coalesce(F.col(explicit).cast("int"), F.when(F.col(key).isNull(), F.col("_turn") % n).otherwise(hashed).cast("int"))).drop("_turn")
