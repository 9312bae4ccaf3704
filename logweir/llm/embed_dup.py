"""Near-duplicate embeddings by NN-descent.

A neighbour graph is started from sorted random-hyperplane codes and refined by joins of neighbours'
neighbours (Dong et al., 2011): whoever shares a neighbour is compared. A list that is full of links is
saturated: there may be more, so its bound doubles from turn to turn. When few lists change
any more, edges at or above the threshold are kept and their components found. The descent promises
no recall, so an exact check follows: all vectors of a label are compared in blocks of bounded size, which counts
every link, audits the descent (``measured``) and joins what it left apart. A block's vectors travel as one row. Equal vectors
are one vertex with a count throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, rebatch
from .components import UnionFind, connected_components

BITS = 24  # hyperplanes of a code
BLOCK = 8192  # vectors of a label that meet as one side of a unit
STRIP = 256  # rows of a unit that are multiplied at once
READ = "vec_id long, node binary, label string, dim int, vec binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node is null for vectors that link with nothing."""
    for b in rebatch(batches, 4096):
        node, vec, dim, labels = [], [], [], b.column(1).to_pylist()
        for x, label in zip(b.column(2).to_pylist(), labels, strict=True):
            v = np.array([], float) if x is None or label is None or any(c is None for c in x) else np.array(x, "<f8")
            n = float(np.sqrt(v @ v)) if v.size and np.isfinite(v).all() else 0.0
            if not np.isfinite(n) and v.size:  # the square overflows
                v = v / np.abs(v).max()
                n = float(np.sqrt(v @ v))
            if n > 0:
                raw = v.tobytes()
                node.append(xxhash.xxh3_128_digest(f"{label}/".encode() + raw))
                vec.append(raw)
            else:
                node.append(None)
                vec.append(None)
            dim.append(v.size)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.binary()), b.column(1), pa.array(dim, pa.int32()), pa.array(vec, pa.binary())], names=["vec_id", "node", "label", "dim", "vec"])


def unit(raw: list[bytes], rows: int | None = None) -> np.ndarray:
    """Rows of length one, in double precision."""
    v = np.frombuffer(b"".join(raw), "<f8").reshape(rows or len(raw), -1)
    m = np.abs(v).max(axis=1, keepdims=True)
    v = v / m
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _codes(seed: int, tables: int):
    """For each table a row per vector, with the bits of its sides of random hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in rebatch(batches, 4096):
            dims = b.column(2).to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), tables * BITS))
                bits = (unit(part.column(3).to_pylist()) @ planes[d] > 0).reshape(-1, tables, BITS)
                code = bits @ (1 << np.arange(BITS - 1, -1, -1))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t), pa.int32()), part.column(1), part.column(2), pa.array(code[:, t].astype(np.int64)), part.column(0), part.column(3)], names=["tab", "label", "dim", "code", "node", "vec"])

    return run


EDGES = "a long, b long, sim double"


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["a", "b", "sim"])


def _along(width: int, best: int):
    """Sorted codes -> each row's best among the following ones of its table and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (key, node, raw)

        def out(rows, final):
            got, n = [], len(rows) if final else max(0, len(rows) - width)
            at = 0
            while at < n:
                key, end = rows[at][0], at
                while end < len(rows) and rows[end][0] == key:
                    end += 1
                v = unit([r[2] for r in rows[at:end]])
                m = end - at
                last = min(m, n - at)
                sims = np.full((last, width), -2.0)
                for s in range(1, min(width, m - 1) + 1):
                    k = min(last, m - s)
                    if k > 0:
                        sims[:k, s - 1] = (v[:k] * v[s : s + k]).sum(axis=1)
                top = np.argpartition(-sims, best - 1, axis=1)[:, :best]
                for i in range(last):
                    got += [(rows[at + i][1], rows[at + i + 1 + int(s)][1], float(sims[i, s])) for s in top[i] if sims[i, s] > -2]
                at = end
            return got, rows[n:]

        for b in batches:
            held += list(zip(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True))
            if len(held) > 20 * width:
                got, held = out(held, final=False)
                yield _edges(got)
        if held:
            yield _edges(out(held, final=True)[0])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows (as columns) of each run of equal leading columns; input sorted by them."""
    held: list[list] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_pylist() for c in b.columns]
        at = 0
        while at < b.num_rows:
            end = at + 1
            key = [c[at] for c in cols[:keys]]
            while end < b.num_rows and all(c[end] == k for c, k in zip(cols, key, strict=False)):
                end += 1
            part = [c[at:end] for c in cols]
            if held is not None and [c[0] for c in held[:keys]] == key:
                held = [h + p for h, p in zip(held, part, strict=True)]
            else:
                if held is not None:
                    yield held
                held = part
            at = end
    if held is not None:
        yield held


def _local_join(best: int):
    """Members of a centre's neighbourhood (centre, chunk, node, least, fresh, vec) -> improving pairs with a fresh member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        for _, _, node, least, fresh, raw in _groups(batches, 2):
            if len(node) > 1 and any(fresh):
                v = unit(raw)
                s = v @ v.T
                np.fill_diagonal(s, -2)
                new = np.array(fresh)
                s[~(new[:, None] | new)] = -2
                k = min(best, len(node) - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                for i, j in zip(np.repeat(np.arange(len(node)), k), top.ravel(), strict=True):
                    if s[i, j] > max(least[i], -2) and node[i] != node[j]:
                        got.append((node[i], node[j], float(s[i, j])))
            if len(got) > 20_000:
                yield _edges(got)
                got = []
        yield _edges(got)

    return run


PACKED = "label string, dim int, own int, n int, nodes binary, comps binary, copies binary, vecs binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, dim, own, node, comp, copies, vec), sorted by the first three -> a row for each block, whose columns are arrays of 8-byte numbers."""
    for label, dim, own, node, comp, copies, raw in _groups(batches, 3):
        cols = [[label[0]], [dim[0]], [own[0]], [len(node)], *[[np.array(x, "<i8").tobytes()] for x in (node, comp, copies)], [b"".join(raw)]]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])


FOUND = "node long, links long, joined long, other long"


class _Block:
    def __init__(self, n: int, nodes: bytes, comps: bytes, copies: bytes, vecs: bytes):
        self.node, self.comp, self.copies = (np.frombuffer(x, "<i8") for x in (nodes, comps, copies))
        v = np.frombuffer(vecs, "<f8").reshape(n, -1)
        self.x = unit([v.tobytes()], n)
        self.links, self.joined = np.zeros(n, np.int64), np.zeros(n, np.int64)


def _exact(threshold: float):
    """Units of two blocks (u, v, own, n, nodes, comps, copies, vecs), or of one -> links of each vertex, with copies,
    and how many of them lie within its component (other is null); pairs of components (node, other) that links join."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(),) * 4
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["node", "links", "joined", "other"])

    def meet(a: _Block, b: _Block, rows: list[tuple]) -> None:
        names, sets = np.unique(np.concatenate([a.comp, b.comp])).tolist(), UnionFind()
        of_a, of_b = (np.searchsorted(names, x.comp) for x in (a, b))
        for at in range(0, len(a.node), STRIP):
            hit = a.x[at : at + STRIP] @ b.x.T >= threshold
            if a is b:
                hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
            i, j = np.nonzero(hit)
            i += at
            same = of_a[i] == of_b[j]
            np.add.at(a.links, i, b.copies[j])
            np.add.at(a.joined, i[same], b.copies[j[same]])
            if a is not b:
                np.add.at(b.links, j, a.copies[i])
                np.add.at(b.joined, j[same], a.copies[i[same]])
            for x, y in np.unique(np.stack([of_a[i[~same]], of_b[j[~same]]], axis=1), axis=0).tolist():
                if sets.union(x, y):
                    rows.append((names[x], 0, 0, names[y]))
        for x in (a,) if a is b else (a, b):
            rows += [(int(x.node[i]), int(x.links[i]), int(x.joined[i]), None) for i in np.flatnonzero(x.links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, u, v, _, *cols in _groups(rebatch(batches, 1), 4):
            blocks, rows = [_Block(*c) for c in zip(*cols, strict=True)], []
            if u[0] == v[0]:
                meet(blocks[0], blocks[0], rows)
            elif len(blocks) == 2:  # a block may be empty
                meet(*blocks, rows)
            for at in range(0, len(rows), 20_000):
                yield table(rows[at : at + 20_000])

    return run


class EmbeddingNeighbours:
    """k: bound of a neighbour list, doubled each turn in which it is full of links, doublings times at most. tables, width: sorted orders of the start, and rows looked ahead in each.
    turns: refinements at most; they end when less than 2 % of the lists' places change, or when one after the first adds less than 0.2 % of the links. audited: all links, in both directions; measured: the share
    of them whose ends the descent had joined by itself, which tells nothing if audited is 0."""

    def __init__(self, threshold: float = 0.93, k: int = 10, tables: int = 5, width: int = 8, turns: int = 4, reverse: int = 24, doublings: int = 2):
        self.threshold, self.k, self.tables, self.width, self.turns, self.reverse, self.doublings = threshold, k, tables, width, turns, reverse, doublings
        self.measured: float | None = None
        self.audited: int | None = None

    def _top(self, edges: DataFrame, turn: int) -> DataFrame:
        """Lists after a turn, of edges (a, b, sim, born): the best k, and of links as many as the doubled bounds allow."""
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "born"))
        one = both.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("born").alias("born"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
        link = (F.col("sim") >= self.threshold) & (F.col("rank") <= self.k << min(turn, self.doublings))
        return one.withColumn("rank", rank).where((F.col("rank") <= self.k) | link)

    def _refine(self, lists: DataFrame, vecs: DataFrame, turn: int) -> DataFrame:
        """Pairs that share a neighbour, one of the two being a neighbour since the last turn: the others have met before."""
        fresh = F.col("born") == turn - 1
        forward = lists.select(F.col("a").alias("c"), F.col("b").alias("node"), fresh.alias("fresh"))
        back = lists.select(F.col("b").alias("c"), F.col("a").alias("node"), fresh.alias("fresh"))
        n = back.groupBy("c").agg(F.ceil(F.count("*") / self.reverse).cast("int").alias("chunks"))
        live = forward.unionAll(back).where("fresh").select("c").distinct()
        back = back.join(n, "c").select("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "node", "fresh")
        forward = forward.join(n, "c", "left").select("c", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"), "node", "fresh")
        least = lists.groupBy(F.col("a").alias("node")).agg(F.when(F.count("*") < self.k, F.lit(-1.0)).otherwise(F.min("sim")).alias("least"))
        rows = forward.unionAll(back).join(live, "c", "left_semi").groupBy("c", "chunk", "node").agg(F.max("fresh").alias("fresh"))
        rows = rows.join(vecs.join(least, "node").select("node", "least", "vec"), "node")
        rows = rows.select("c", "chunk", "node", "least", "fresh", "vec").repartition("c", "chunk").sortWithinPartitions("c", "chunk")
        return rows.mapInArrow(_local_join(4), EDGES)

    def links(self, table: DataFrame) -> DataFrame:
        """table (vec_id, label, embedding, ...) -> vec_id, n_links, component_id, kept: a row per input row.

        Vectors of one label and length link at a cosine of ``threshold`` or more. Vectors, or
        labels, that are null, zero vectors and those with null or non-finite components link with
        nothing. A null vec_id has a null component and is kept, and is no other row's component. Repeated rows link with each other like other
        equal vectors. Vectors of any length are compared whole; a cosine of exactly the threshold is a link, and among ties ids decide, so no result depends on order.
        An empty table gives an empty result; further columns are not read.
        """
        spark = table.sparkSession
        work = Workspace(spark, "embed_dup")
        rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
        t = work.stage(rows.mapInArrow(_read, READ), "vectors")
        vecs = t.where("node IS NOT NULL").groupBy("node", "label", "dim").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
        vecs = work.stage(vecs.withColumnRenamed("node", "print").withColumn("node", F.monotonically_increasing_id()), "classes")
        total = vecs.count()
        codes = vecs.select("node", "label", "dim", "vec").mapInArrow(_codes(1000, self.tables), "tab int, label string, dim int, code long, node long, vec binary")
        codes = codes.repartitionByRange("tab", "label", "dim", "code", "node").sortWithinPartitions("tab", "label", "dim", "code", "node")
        seen = work.stage(codes.mapInArrow(_along(self.width, 3), EDGES), "edges")
        close = seen.where(F.col("sim") >= self.threshold)
        lists = work.stage(self._top(seen.withColumn("born", F.lit(0)), 0), "lists")
        for turn in range(1, self.turns + 1):
            new = work.stage(self._refine(lists, vecs, turn), "edges")
            close = close.unionAll(new.where(F.col("sim") >= self.threshold))
            both = lists.select("a", "b", "sim", "born").unionAll(new.withColumn("born", F.lit(turn)))
            old, lists = lists, work.stage(self._top(both, turn), "lists")
            work.drop(old)
            changed, linked = lists.where(F.col("born") == turn).agg(F.count("*"), F.sum((F.col("sim") >= self.threshold).cast("long"))).first()
            if changed < 0.02 * total * self.k or (turn > 1 and (linked or 0) <= 0.002 * lists.where(F.col("sim") >= self.threshold).count()):
                break
        comps = connected_components(work, close.select("a", "b"))
        of = vecs.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        of = work.stage(of.select("node", "print", "label", "dim", "copies", "rep", "comp", "vec"), "joined")
        found = work.stage(self._all_pairs(of), "found")
        got = found.agg(F.sum("links"), F.sum("joined")).first()
        self.audited = got[0] or 0
        self.measured = got[1] / got[0] if got[0] else 1.0
        roots = connected_components(work, found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
        roots = roots.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        of = of.select("node", "print", "copies", "rep", "comp").join(roots, "comp", "left").select("node", "print", "copies", "rep", F.coalesce("root", "comp").alias("comp"))
        counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
        least = work.stage(of.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")  # a written side lets hot components be split
        res = of.join(least, "comp").join(counts, "node", "left").select(F.col("print").alias("node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        res = work.stage(res, "result")
        out = t.select("vec_id", "node").join(res, "node", "left")
        cid = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
        return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(cid == F.col("vec_id"), F.lit(True)).alias("kept"))

    def _all_pairs(self, of: DataFrame) -> DataFrame:
        """Every pair of vectors of a label and length meets in one unit of two blocks."""
        size = of.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        m = of.join(size, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        m = m.select("label", "dim", "own", "node", "comp", "copies", "vec").repartition("label", "dim", "own").sortWithinPartitions("label", "dim", "own")
        m = m.mapInArrow(_packed, PACKED).join(size, ["label", "dim"])
        m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        m = m.select("label", "dim", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "own", "n", "nodes", "comps", "copies", "vecs")
        m = m.repartition("label", "dim", "u", "v").sortWithinPartitions("label", "dim", "u", "v")
        return m.mapInArrow(_exact(self.threshold), FOUND)
