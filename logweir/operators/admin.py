"""Topic and group administration over a small catalogue of Parquet tables.

Each change writes a new version directory and then an empty file that names it; the greatest name is
the current version. Creating a file is one step, so readers see whole versions, and a writer lost at any point
leaves the old one. The catalogue has one writer; producer ids may be drawn by many.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import GROUP_OFFSETS, TOPICS

CAPABILITIES = {"durable": True, "restart_safe": True, "idempotent": True, "transactions": True, "timestamps": True, "headers": True, "compression": "parquet", "lease": "single writer"}
DEFAULT_PARTITIONS, AUTO_CREATE = 1, False


class LogError(Exception):
    """An error of the log's interface; code is its name."""

    def __init__(self, code: str, what: str = ""):
        super().__init__(f"{code}: {what}" if what else code)
        self.code = code


def capabilities(spark: SparkSession) -> DataFrame:
    """What the store promises."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in CAPABILITIES.items()])


class Catalog:
    """Topics, truncations, committed offsets and producer ids below one path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _versions(self, name: str) -> list[str]:
        folder = self._p(f"{name}.versions")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _read(self, name: str, schema) -> DataFrame:
        """A snapshot table is its last version, a log (its versions end in +) all since the last snapshot."""
        done = self._versions(name)
        start = max((i for i, v in enumerate(done) if not v.endswith("+")), default=0)
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{v}" for v in done[start:]])

    def _write(self, name: str, df: DataFrame, append: bool = False) -> None:
        done = self._versions(name)
        n = int(done[-1].split("-")[0]) + 1 if done else 0
        version = f"{n:012d}-{uuid.uuid4().hex}{'+' * append}"
        df.write.parquet(f"{self.path}/{name}/{version}")
        self._publish(name, version)

    def _publish(self, name: str, version: str) -> bool:
        """Whether the version is new."""
        return self._fs.createNewFile(self._p(f"{name}.versions/{version}"))

    def topics(self) -> DataFrame:
        return self._read("topics", TOPICS).orderBy("topic")

    def topic_partitions(self, name: str) -> int | None:
        row = self.topics().where(F.col("topic") == name).first()
        return row and row.partitions

    def create_topic(self, name: str, partitions: int = DEFAULT_PARTITIONS, adopt: bool = False) -> None:
        """adopt: an existing topic of the same size is taken over, as after a restart; another size is an error."""
        found = self.topic_partitions(name)
        if partitions < 1:
            raise LogError("InvalidPartitions", str(partitions))
        if found is not None:
            if adopt and found == partitions:
                return
            raise LogError("TopicExists", name)
        new = self.spark.createDataFrame([(name, partitions)], TOPICS)
        self._write("topics", self.topics().unionAll(new))

    def create_partitions(self, name: str, partitions: int) -> None:
        found = self.topic_partitions(name)
        if found is None:
            raise LogError("UnknownTopicOrPartition", name)
        if partitions <= found:
            raise LogError("InvalidPartitions", f"{name} has {found}")
        n = F.when(F.col("topic") == name, partitions).otherwise(F.col("partitions")).cast("int")
        self._write("topics", self.topics().withColumn("partitions", n))

    def get_or_create_topic(self, name: str) -> int:
        """Partitions of a topic; an unknown one is created with the default if AUTO_CREATE is set."""
        found = self.topic_partitions(name)
        if found is None:
            if not AUTO_CREATE:
                raise LogError("UnknownTopicOrPartition", name)
            self.create_topic(name)
            found = DEFAULT_PARTITIONS
        return found

    def delete_topic(self, name: str) -> None:
        if self.topic_partitions(name) is None:
            raise LogError("UnknownTopicOrPartition", name)
        self._write("topics", self.topics().where(F.col("topic") != name))

    def partitions(self) -> DataFrame:
        return self.topics().select("topic", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("part"))

    def check_partition(self, name: str, part: int) -> None:
        n = self.topic_partitions(name)
        if n is None or not 0 <= part < n:
            raise LogError("UnknownTopicOrPartition", f"{name}/{part}")

    def commit_offsets(self, rows: list[tuple[int, str, str, int, int | None]]) -> None:
        """Appends (seq, group, topic, partition, offset); a null offset deletes the key. Earlier commits are not read."""
        self._write("offsets", self.spark.createDataFrame(rows, GROUP_OFFSETS), append=True)

    def compact_offsets(self) -> None:
        """Leaves the last commit of each key."""
        m = self._read("offsets", GROUP_OFFSETS).groupBy("group_id", "topic", "partition").agg(F.max(F.struct("seq", "offset")).alias("m"))
        self._write("offsets", m.select("m.seq", "group_id", "topic", "partition", "m.offset").where("offset IS NOT NULL"))

    def offsets(self) -> DataFrame:
        m = self._read("offsets", GROUP_OFFSETS).groupBy("group_id", "topic", "partition").agg(F.max(F.struct("seq", "offset")).alias("m"))
        return m.select("group_id", "topic", "partition", F.col("m.offset").alias("offset")).where("offset IS NOT NULL")

    def init_producer_id(self) -> int:
        """Ids from 1 on, each once, also among several writers: an id is taken by creating its file."""
        done = self._versions("producer_ids")
        n = int(done[-1]) + 1 if done else 1
        while not self._publish("producer_ids", f"{n:020d}"):
            n += 1
        return n


class Registry:
    """Leaders of partitions as a broker knows them: owner and leader epoch."""

    def __init__(self, node: int):
        self.node, self.rows = node, {}

    def register(self, topic: str, owners: list[int]) -> None:
        for p, o in enumerate(owners):
            self.rows[topic, p] = (o, 0)

    def deregister(self, topic: str) -> None:
        self.rows = {k: v for k, v in self.rows.items() if k[0] != topic}

    def reassign(self, topic: str, part: int, owner: int) -> int:
        epoch = self.leader(topic, part)[1] + 1
        self.rows[topic, part] = (owner, epoch)
        return epoch

    def leader(self, topic: str, part: int) -> tuple[int, int]:
        """(owner, epoch). A topic that is not registered is one's own."""
        if not any(t == topic for t, _ in self.rows):
            return self.node, 0
        if (topic, part) not in self.rows:
            raise LogError("NotLeaderOrFollower", f"{topic}/{part}")
        return self.rows[topic, part]

    def require_self(self, topic: str, part: int) -> None:
        if self.leader(topic, part)[0] != self.node:
            raise LogError("NotLeaderOrFollower", f"{topic}/{part}")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, p, o, e) for (t, p), (o, e) in sorted(self.rows.items())], "topic STRING, part INT, owner INT, leader_epoch INT")
