"""Connected components of an edge table: union-find within tasks, then alternating star contraction.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014) need O(log^2 n) rounds at most. Each step is a minimum per vertex, pre-aggregated, and a join
back to the edges. Both sides of the joins are written tables, so the adaptive skew join can split the
edges of a hub over tasks: no step needs a vertex's edges together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


class UnionFind:
    """Disjoint sets with the least member as root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up, root = self.up, x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while (nxt := up.get(x, x)) != root:
            up[x] = root
            x = nxt
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _forest(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uf, schema = UnionFind(), None

        def out():
            pairs = [(k, uf.find(k)) for k in list(uf.up)]
            pairs = [(k, r) for k, r in pairs if k != r]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.field(i).type) for i in (0, 1)], schema=schema)

        for b in batches:
            schema = b.schema
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                uf.union(x, y)
            if len(uf.up) > limit:
                yield out()
                uf = UnionFind()
        if uf.up:
            yield out()

    return run


def connected_components(work: Workspace, edges: DataFrame, limit: int = 500_000) -> DataFrame:
    """edges (a, b) of one comparable type -> staged (node, comp): the least node reachable.

    Nodes without an edge to another node have no row. limit bounds a task's union-find.
    """
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"a {kind}, b {kind}"
    edges = edges.select("a", "b").where("a <> b")
    e = work.stage(edges.mapInArrow(_forest(limit), schema).distinct(), "forest")
    last = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.stage(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = work.stage(large, "large")  # every row points to a smaller node
        low = work.stage(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b")))
        nxt = work.stage(small.distinct(), "star")
        now = tuple(nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        work.drop(e, least, large, low)
        e = nxt
        if now == last or now[0] == 0:
            break
        last = now
    both = e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("comp")))
    out = work.stage(both.groupBy("node").agg(F.min("comp").alias("comp")), "components")
    work.drop(e)
    return out
