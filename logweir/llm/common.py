"""Shared helpers: staged tables in the shared folder, column selection, label splits.

Conventions of every operator here:

* only the named columns are read, so extra columns (also clashing ones) never matter;
* a null text is an empty text; a null id is carried through unchanged;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may leave it out: then one below the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work").rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables of one operator's run. They cut lineage; a lost executor never loses them.

    ``stage`` writes and rereads a frame; ``drop`` removes tables that nothing lazy reads any more.
    What is left goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def _close(self) -> None:
        with contextlib.suppress(Exception):
            _delete(self.spark, self.root)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if path := t is not None and t.__dict__.pop("_staged_at", None):
                self._remove(path)

    def keep(self, *tables: DataFrame) -> None:
        """Removes all tables but these."""
        names = {t._staged_at.rsplit("/", 1)[1] for t in tables}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for f in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root):
            if f.getPath().getName() not in names:
                self._remove(f.getPath().toString())

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Exception):  # what is left goes at the end
            _delete(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo; a null id is held out of learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(True))


def labelled_sample(labels: DataFrame, target: str, learn: Column, per_class: int) -> DataFrame:
    """At most per_class ids of each class among rows to learn from, by hash order.

    The bound makes the result small enough to broadcast at any input size. Rows with null
    id or label are left out; an id with several labels keeps its least.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & learn)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(target).cast("int")).alias("label"))
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionAll(parts[1])


def tidy(run: Callable) -> Callable:
    """A task's function that gives its freed memory back at the end: workers live on and are shared by stages."""

    def with_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return with_end


def rebatch(batches: Iterable, rows: int = 512, size: int = 4 << 20) -> Iterator:
    """Slices of Arrow batches of at most so many rows, and of so many bytes or one row."""
    for b in batches:
        n = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)
