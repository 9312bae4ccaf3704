"""Connected components by least labels, for graphs of producers and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in spark.checkpoint.dir; below the warehouse if that is unset, as in tests."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, comp: the least node reachable, for every node that has an edge.

    Each round hooks roots to lesser roots next to them and then jumps to the root's root, so rounds grow with the logarithm of the diameter.
    """
    edges = checkpointed(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    comp = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"))
    while True:
        comp = checkpointed(comp)
        far = edges.join(comp.select(F.col("node").alias("b"), F.col("comp").alias("m")), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m"))
        near = comp.join(far, "node").select("node", "comp", F.least("comp", "m").alias("m"))
        root = near.groupBy(F.col("comp").alias("node")).agg(F.min("m").alias("m"))  # what any member of a label has found
        hooked = checkpointed(near.join(root.withColumnsRenamed({"node": "comp", "m": "least"}), "comp").select("node", F.col("comp").alias("was"), F.least("m", "least").alias("comp")))
        jump = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        nxt = checkpointed(hooked.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        if nxt.where("comp <> was").isEmpty():
            return nxt.select("node", "comp")
        comp = nxt.select("node", "comp")
