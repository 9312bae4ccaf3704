"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups.

Ertl's SuperMinHash (2017) gives each element one random permutation of the slots and one uniform
number per rank; slot j holds the least (rank + number) of any element. Its correlated ranks give
lower variance than independent hashes, and ranks above the largest slot value cannot change
anything, so elements stop early. Here all elements of a batch advance rank by rank together.

Plan: one pass over the texts makes (set size, set fingerprint, band keys). Documents with the same
set are one class and one vertex, so exact copies never meet in a bucket. Buckets with the same
members are kept once. All members of a bucket are compared with one hub, the member that shares
most buckets with others, on the full shingle sets of the whole texts: rows in proportion to the members.

Of a hub's members that are not linked to it, o can have a link to another member z only if o and z
share t(|o| + |z|) shingles, t = percent / (100 + percent). Of these, at most c(o) lie within the
hub, c(o) being what o shares with it, and the others are shingles outside it that several members hold.
So each member's shingles outside the hub are counted, and a member that has too few shared ones for
any partner is done. In a group of copies that were edited each in its own way, that is all of them.
What is left meets the other members of its hub in units of bounded size. Every link is confirmed on full sets,
and texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, id_text, rebatch, tidy
from .components import UnionFind, connected_components

MEMO = 200_000  # words whose hashes a worker remembers
GOLD = 0x9E3779B97F4A7C15
MUL = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2545F4914F6CDD1D], dtype=np.uint64)


def _times(t: int) -> np.uint64:
    return np.uint64(GOLD * t % (1 << 64))


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z in lower case, words between ASCII space.

    Fewer than k words: the whole sequence is one shingle. No word: none.
    """
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < k:
        return mix(np.array([np.bitwise_xor.reduce(w * MUL[:n]) ^ _times(n)], np.uint64))
    h = w[: n - k + 1] * MUL[0]
    for i in range(1, k):
        h = h + w[i : n - k + 1 + i] * MUL[i]
    return np.unique(mix(h))


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signature matrix (sets, m) of float64; an empty set keeps infinities."""
    sig = np.full(len(sets) * m, np.inf)
    size = np.array([len(s) for s in sets])
    if not size.sum():
        return sig.reshape(-1, m)
    h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    past: list[np.ndarray] = []
    for t in range(m):
        z = mix(h + _times(t + 1))
        r = (z >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = (t + (((mix(z) >> np.uint64(32)) * np.uint64(m - t)) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        at = k.copy()
        for s in range(t - 1, -1, -1):  # where the value now at k was before the swaps
            at[at == past[s]] = s
        past.append(k)
        np.minimum.at(sig, doc * m + at, t + r)
        open_ = sig.reshape(-1, m).max(axis=1) >= t + 1
        go = open_[doc]
        if not go.all():
            h, doc, past = h[go], doc[go], [p[go] for p in past]
            if not len(h):
                break
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int) -> list[list[int]]:
    r = sig.shape[1] // bands
    return [[xxhash.xxh3_64_intdigest(row[b * r : (b + 1) * r].tobytes(), b) - (1 << 63) for b in range(bands)] for row in sig]


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


SKETCH = "doc_id long, n_shingles long, node binary, bands array<long>"
CHUNK = 512  # members that meet a copy of their hub, or of a block of members, in one run of rows
AGAINST = "hub long, v long, size int, linked boolean, need int, inside binary, rest array<long>"


def _sketch(k: int, bands: int, rows: int, elements: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])

        def out(ids, sets):
            keys = band_keys(superminhash(sets, bands * rows), bands)
            n = [len(s) for s in sets]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array([x if c else None for x, c in zip(keys, n, strict=True)], pa.list_(pa.int64()))], schema=schema
            )

        for b in rebatch(batches):
            ids, sets, held = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                s = shingles(t.as_py(), k)
                ids.append(i)
                sets.append(s)
                held += len(s)
                if held > elements:
                    yield out(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield out(ids, sets)
        _words.clear()

    return tidy(run)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple]]:
    """Rows whose last columns are node and text -> their other columns and the shingle set, batch by batch."""
    for b in rebatch(batches):
        rows = []
        for *row, node, text in zip(*(b.column(i).to_pylist() for i in range(b.num_columns - 1)), b.column(b.num_columns - 1).cast(pa.binary()), strict=True):
            s = shingles(text.as_py(), k)
            if fingerprint(s) == node:  # else, of an id with several texts, this row is of another class
                rows.append((*row, s))
        yield rows
    _words.clear()


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    cols = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(cols)], names=[n for n, _ in cols])


def _against(k: int, percent: int):
    """Rows (hub, chunk, v, smallest, node, text), each chunk led by the hub itself -> AGAINST, a row per other member.

    smallest: the least size of a partner. inside: which of the hub's sorted shingles the member has, as bits; rest: its shingles outside
    the hub. Together they are the whole set. need: as many of the rest must be shared for a link to another member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for rows in _sets(batches, k):
            got: list[tuple] = []
            for h, chunk, v, smallest, s in rows:
                if v == h:
                    at, hub = (h, chunk), s
                    continue
                if at != (h, chunk):
                    raise ValueError("a chunk of near copies without its hub")
                where = np.minimum(np.searchsorted(hub, s), len(hub) - 1)
                inside, held = hub[where] == s, np.zeros(len(hub), bool)
                held[where[inside]] = True
                c, n, m = int(inside.sum()), len(s), len(hub)
                need = -(-percent * (n + max(smallest, -(-percent * n // 100))) // (100 + percent)) - c
                got.append((h, v, n, 100 * c >= percent * (n + m - c), need, np.packbits(held).tobytes(), s[~inside].view(np.int64)))
            yield _table(got, AGAINST)

    return tidy(run)


def _units(percent: int):
    """Rows (hub, chunk, block, v, comp, size, first, inside, rest), each unit led by its block's members (first) -> links (a, b) that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, index = None, [], None
        for b in rebatch(batches):
            got: list[tuple] = []
            for h, chunk, part, v, comp, n, first, inside, rest in zip(*(b.column(i).to_pylist() for i in range(8)), b.column(8), strict=True):
                inside, rest = np.frombuffer(inside, np.uint8), rest.values.to_numpy()
                if at != (h, chunk, part):
                    at, block, index, sets = (h, chunk, part), [], None, UnionFind()
                if first:
                    block.append((v, comp, n, inside, rest))
                    continue
                if not block:
                    continue
                if index is None:
                    size, held = np.array([x[2] for x in block]), np.stack([x[3] for x in block])
                    every, owner = np.concatenate([x[4] for x in block]), np.repeat(np.arange(len(block)), [len(x[4]) for x in block])
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order]
                lo, hi = np.searchsorted(index[0], rest, "left"), np.searchsorted(index[0], rest, "right")
                k = hi - lo
                where = np.repeat(lo - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
                both = np.bincount(index[1][where], minlength=len(block)) + np.bitwise_count(held & inside).sum(axis=1)
                for i in np.flatnonzero(100 * both >= percent * (size + n - both)):
                    if block[i][0] != v and sets.union(block[i][1], comp):
                        got.append((block[i][0], v))
            yield _table(got, "a long, b long")

    return tidy(run)


class NearDuplicates:
    """Groups of near copies.

    k, percent: shingle words, least Jaccard similarity in percent. bands x rows slots are
    banded; at similarity s a pair shares no bucket with probability (1 - s^rows)^bands: 8e-7 at 0.85,
    7e-5 at 0.80. That is the only way to lose a link; ``tests/llm`` measures the recall.
    """

    def __init__(self, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 5):
        if not 1 <= k <= len(MUL):
            raise ValueError(f"k is from 1 to {len(MUL)}")
        self.k, self.percent, self.bands, self.rows = k, percent, bands, rows

    def _pairs(self, classes: DataFrame, work: Workspace) -> DataFrame:
        """The hub of each band bucket with each other member, once: hub, chunk, v, and the least size of a bucket they share."""
        rows = classes.select(F.explode("bands").alias("key"), "size", "v")
        keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.bit_xor(F.xxhash64("v")).alias("sum"), F.min("size").alias("smallest")).where("n > 1")
        keys = work.stage(keys.groupBy("n", "least", "sum").agg(F.min("key").alias("key"), F.min("smallest").alias("smallest")).select("key", "n", "smallest"), "buckets")
        members = work.stage(rows.select("key", "v").join(keys, "key"), "members")
        members = members.withColumn("rank", F.sum("n").over(Window.partitionBy("v")))
        hubs = work.stage(members.groupBy("key").agg(F.max(F.struct("rank", "v")).alias("hub")).select("key", F.col("hub.v").alias("hub")), "hubs")
        one = members.join(hubs, "key").where("v <> hub").groupBy("hub", "v").agg(F.max("n").alias("n"), F.min("smallest").alias("smallest"))
        return work.stage(one.select("hub", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("chunk"), "v", "smallest"), "pairs")

    def _compare(self, pairs: DataFrame, classes: DataFrame, docs: DataFrame, work: Workspace) -> DataFrame:
        """Members against their hubs. The join that fetches texts is a sort merge at every size, so it takes the same way on small inputs."""
        heads = pairs.select("hub", "chunk").distinct().select("hub", "chunk", F.col("hub").alias("v"), F.lit(0).alias("smallest"))
        asked = pairs.unionByName(heads).join(classes.select("v", "node", "rep"), "v")
        text = docs.select(F.col("doc_id").alias("rep"), "text").hint("merge")
        rows = asked.join(text, "rep").select("hub", "chunk", "v", "smallest", "node", "text")
        rows = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("v") != F.col("hub"))
        return work.stage(rows.mapInArrow(_against(self.k, self.percent), AGAINST), "against")

    def _left(self, against: DataFrame, comps: DataFrame, work: Workspace) -> DataFrame:
        """Members that may have a link to a member of another component: hub, v, comp, whether that is open."""
        comps = comps.withColumnRenamed("node", "v")
        m = against.select("hub", "v", "linked").join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        m = work.stage(m, "seen")
        live = work.stage(m.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("linked").alias("all")).where("lo <> hi AND NOT all").select("hub"), "live")
        rows = against.join(live, "hub", "left_semi")
        rest = rows.select("hub", "v", "linked", F.explode("rest").alias("shingle"))
        shared = work.stage(rest.groupBy("hub", "shingle").agg(F.count("*").alias("n")).where("n > 1").select("hub", "shingle"), "shared")
        count = rest.where("NOT linked").join(shared, ["hub", "shingle"], "left_semi").groupBy("hub", "v").agg(F.count("*").alias("shared"))
        open_ = rows.where("NOT linked").join(count, ["hub", "v"], "left").where(F.coalesce("shared", F.lit(0)) >= F.col("need")).select("hub", "v")
        open_ = work.stage(open_.withColumn("open", F.lit(True)), "open")
        hubs = work.stage(open_.groupBy("hub").agg(F.count("*").alias("opens")), "hubs")
        out = m.select("hub", "v", "comp").join(hubs, "hub").join(open_, ["hub", "v"], "left")
        return work.stage(out.withColumn("open", F.coalesce("open", F.lit(False))), "left")

    def _rest(self, left: DataFrame, against: DataFrame, work: Workspace) -> DataFrame:
        """Open members against all members of their hub, in units of a block of the open ones and a chunk of all. The sets are at hand: no text is read."""
        n = work.stage(left.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.ceil(F.max("opens") / CHUNK).cast("int").alias("blocks")), "sizes")
        d = left.drop("opens").join(n, "hub").withColumn("hash", F.xxhash64("v"))
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c: F.pmod("hash", F.col(c)).cast("int")
        lead = d.where("open").withColumn("chunk", each("chunks")).withColumn("block", own("blocks")).withColumn("first", F.lit(True))
        follow = d.withColumn("block", each("blocks")).withColumn("chunk", own("chunks")).withColumn("first", F.lit(False))
        asked = work.stage(lead.unionByName(follow).select("hub", "chunk", "block", "v", "comp", "first"), "asked")
        rows = asked.join(against.select("hub", "v", "size", "inside", "rest"), ["hub", "v"]).select("hub", "chunk", "block", "v", "comp", "size", "first", "inside", "rest")
        rows = rows.repartition("hub", "chunk", "block").sortWithinPartitions("hub", "chunk", "block", F.desc("first"))
        return work.stage(rows.mapInArrow(_units(self.percent), "a long, b long"), "links")

    def groups(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept: a row per input row.

        component_id: the least doc_id reachable by links, itself included. Documents without
        words (null, empty or blank texts) link with nothing. A row with a null id has a null component_id and is kept.
        Rows that repeat an id and a text share one result; of an id's different texts each has
        its own group. Ties do not arise: ids order all choices. An empty table gives an empty result;
        further columns are not read, whatever their names.
        """
        spark = docs.sparkSession
        work, docs = Workspace(spark, "near_dup"), id_text(docs)
        t1 = work.stage(docs.mapInArrow(_sketch(self.k, self.bands, self.rows), SKETCH), "sketch")
        classes = t1.where("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").cast("int").alias("size"), F.first("bands").alias("bands"))
        classes = work.stage(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
        pairs = self._pairs(classes, work)
        against = self._compare(pairs, classes, docs, work)
        links = work.stage(against.where("linked").select(F.col("hub").alias("a"), F.col("v").alias("b")), "links")
        comps = connected_components(work, links)
        left = self._left(against, comps, work)
        if not left.isEmpty():
            more = self._rest(left, against, work)
            if not more.isEmpty():
                comps = connected_components(work, links.unionAll(more))
        of = classes.select("node", "rep", "v").join(comps.withColumnRenamed("node", "v"), "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        least = work.stage(of.groupBy("comp").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1").select("comp", "least"), "least")
        of = work.stage(of.join(least, "comp", "left").select("node", F.coalesce("least", "rep").alias("rep")), "component_of")
        out = t1.select("doc_id", "n_shingles", "node").join(of, "node", "left")
        cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
        res = work.stage(out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept")), "groups")
        work.keep(res)
        return res

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that stay: the least doc_id of each group, once, and rows with a null id.

        Of an id's different texts all stay if one does; rows that repeat id and text become one.
        Documents without words stay. All columns stay as they are; an empty table stays empty.
        The join is a sort merge at every size: the ids that stay grow with the input, so they are never broadcast.
        """
        work = Workspace(docs.sparkSession, "near_dup")
        kept = work.stage(self.groups(docs).where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept")
        once = docs.hint("merge").join(kept.where("rows = 1").select("doc_id"), "doc_id", "left_semi")
        if not kept.where("rows > 1").isEmpty():
            again = docs.join(kept.where("rows > 1").select("doc_id"), "doc_id", "left_semi")
            once = once.unionAll(again.dropDuplicates(["doc_id", "text"]))
        return once.unionAll(docs.where("doc_id IS NULL")).select(docs.columns)
