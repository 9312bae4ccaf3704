import struct

import pytest
from pyspark.sql import functions as F

from logweir.functions import frames, payload as generated
from logweir.functions.graph import components
from logweir.functions.prefix import numbered, previous
from logweir.functions.fnv import big_endian_32, constant, fnv1a, fnv1a_int, hex64, mix64, rotate_left, unsigned_mod
from logweir.operators import admin, analytics, flush, groups, routing, sequencer, txn, views


def test_fnv(spark):
    keys = ["", "a", "orders", "ünï", "x" * 60]
    d = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, p int")
    h = fnv1a(F.concat(F.col("k").cast("binary"), big_endian_32(F.col("p"))))
    for r in d.select("k", "p", hex64(h).alias("h"), unsigned_mod(h, 5).alias("m")).collect():
        want = fnv1a_int(r.k.encode() + struct.pack(">I", r.p))
        assert (r.h, r.m) == (f"{want:016x}", want % 5)
    assert spark.range(1).select(hex64(fnv1a(F.lit(b""))).alias("h")).first().h == "cbf29ce484222325"


def payload(base, count, extra=0):
    body = bytearray(61 + extra)
    struct.pack_into(">q", body, 0, base)
    struct.pack_into(">i", body, 8, len(body) - 12)
    body[16] = 2
    struct.pack_into(">i", body, 57, count)
    return bytes(body)


def test_frames(spark):
    both = payload(0, 2, 5) + payload(0, 3) + b"tail"
    out = frames.stamp_all(both, 10)
    assert struct.unpack_from(">q", out, 0)[0] == 10 and struct.unpack_from(">q", out, 66)[0] == 12 and out.endswith(b"tail")
    assert frames.stamp_all(b"12345678rest", 7)[:8] == struct.pack(">q", 7) and frames.stamp_all(b"xy", 7) == b"xy"
    d = spark.createDataFrame([(payload(5, 3),), (payload(-1, 0),), (b"short",), (None,)], "b binary")
    got = d.select(frames.record_count(F.col("b")).alias("n"), frames.base_offset(F.col("b")).alias("o"), frames.stamp_first(F.col("b"), F.lit(9)).alias("s")).collect()
    assert [r.n for r in got] == [3, 1, 1, 1] and [r.o for r in got] == [5, -1, None, None]
    assert bytes(got[0].s) == frames.stamp_all(payload(5, 3), 9) and bytes(got[2].s) == b"short"


def test_routing(spark):
    peers = spark.createDataFrame([("3@host:a:9092",), ("1@h:1",)], "peer string")
    assert [tuple(r) for r in routing.parse_peers(peers).collect()] == [(3, "host:a", 9092), (1, "h", 1)]
    parts = spark.createDataFrame([("orders", p) for p in range(64)], "topic string, part int")
    for n in (2, 3, 5):
        led = [r.leader for r in routing.leader_for(parts, list(range(n))).collect()]
        assert led == [r.leader for r in routing.leader_for(parts, list(range(n))[::-1]).collect()]
        assert all(0 < led.count(i) < 3 * 64 / n for i in range(n))
    assert parts.select(routing.leader_index(F.col("topic"), F.col("part"), 0).alias("l")).first().l is None


def test_transactions(spark):
    ev = [(0, 1, "init"), (1, 1, "produce"), (2, 1, "stage"), (3, 1, "commit"), (4, 1, "produce"), (5, 1, "abort"), (6, 1, "commit"), (7, 1, "produce"), (8, 1, "init"), (9, 1, "produce"), (10, 2, "produce"), (11, 2, "stage"), (12, 2, "commit")]
    d = spark.createDataFrame(ev, "seq long, producer long, kind string")
    assert {r.seq: r.state for r in txn.resolve(d).collect()} == {1: "committed", 4: "aborted", 7: "discarded", 9: "open", 10: "none"}
    assert {r.seq: r.state for r in txn.resolve(d, True).collect()}[7] == "aborted"
    assert [tuple(r) for r in txn.apply_offsets(d).collect()] == [(1, 3, 2)]
    assert {r.producer: r.epoch for r in txn.epochs(d).collect()} == {1: 1, 2: -1}
    assert [tuple(r) for r in txn.open_transactions(d).collect()] == [(1, 8)]
    assert [r.producer for r in txn.expired(d, 20, 5).collect()] == [1] and txn.expired(d, 10, 5).count() == 0
    assert {r.seq: r.fenced for r in txn.fence(d).collect()}[1] is True


def test_groups(spark):
    log = spark.createDataFrame([(0, "g", "m1", "join"), (1, "g", "m2", "join"), (2, "g", "m1", "join"), (3, "g", "m2", "leave"), (4, "g", "m3", "join"), (5, "e", "x", "join"), (6, "e", "x", "leave"), (7, "e", "x", "leave")], "seq long, grp string, member string, kind string")
    assert {r.grp: tuple(r)[1:] for r in groups.group_state(log).collect()} == {"g": (4, 2, "m1"), "e": (2, 0, None)}
    ask = spark.createDataFrame([("no", "m1", 4), ("g", "m1", 3), ("g", "m2", 4), ("g", "m3", 4)], "grp string, member string, generation long")
    assert [r.code for r in groups.heartbeat(ask, log).orderBy("grp", "generation", "member").collect()] == [22, 25, 0, 16]
    given = spark.createDataFrame([("g", "m3", "a"), ("g", "m2", "b")], "grp string, member string, assignment string")
    assert {(r.member, r.code): r.assignment for r in groups.sync(ask, log, given).collect()} == {("m1", 16): None, ("m1", 22): None, ("m2", 25): None, ("m3", 0): "a"}
    assert sorted(tuple(r) for r in groups.range_assignment(log, 3).where("grp = 'g'").collect()) == [("g", 0, "m1"), ("g", 1, "m3"), ("g", 2, "m1")]
    off = spark.createDataFrame([(0, 1, "t", 0, 50), (1, 1, "t", 1, 60), (2, 2, "t", 0, 999), (3, 1, "t", 0, 40), (4, 1, "t", 1, None)], "seq long, grp int, topic string, part int, committed long")
    latest = groups.latest_offsets(off)
    assert sorted(tuple(r) for r in latest.collect()) == [(1, "t", 0, 40), (2, "t", 0, 999)]
    assert groups.delete_group(latest, 1).count() == 1 and groups.delete_offset(latest, 2, "t", 0).count() == 1
    assert groups.fetch_response(latest).first().leader_epoch == -1


def test_fetch_first_batch_always_comes(spark):
    bat = spark.createDataFrame([(i, "t", 0, 10 * i, 10, 500) for i in range(5)], "commit_seq long, topic string, part int, base_offset long, record_count long, byte_len long")
    assert [[r.base_offset for r in views.fetch(bat, 15, m).orderBy("base_offset").collect()] for m in (-5, 0, 499, 1000, 10**9)] == [[10], [10], [10], [10, 20], [10, 20, 30, 40]]
    assert views.fetch(bat, 50, 100).count() == 0
    with pytest.raises(ValueError):
        views.truncate_strict(bat, 20, 50, 10)


def test_catalog(spark, tmp_path):
    c = admin.Catalog(spark, str(tmp_path / "cat"))
    assert c.topics().count() == 0 and c.topic_partitions("a") is None
    c.create_topic("b", 2)
    c.create_topic("a")
    with pytest.raises(admin.LogError, match="TopicExists"):
        c.create_topic("b", 2)
    c.create_topic("b", 2, adopt=True)
    with pytest.raises(admin.LogError):
        c.create_topic("b", 3, adopt=True)
    c.create_partitions("b", 4)
    assert [tuple(r) for r in c.topics().collect()] == [("a", 1), ("b", 4)] and c.partitions().count() == 5
    c.check_partition("b", 3)
    with pytest.raises(admin.LogError, match="Unknown"):
        c.check_partition("b", 4)
    c.delete_topic("a")
    assert c.topics().count() == 1
    c.commit_offsets([(0, "g", "b", 0, 5), (1, "g", "b", 0, 7), (2, "g", "b", 1, 3), (3, "g", "b", 1, None)])
    assert [tuple(r) for r in c.offsets().collect()] == [("g", "b", 0, 7)]
    assert [c.init_producer_id(), c.init_producer_id()] == [1, 2]
    r = admin.Registry(1)
    assert r.leader("t", 0) == (1, 0)
    r.register("t", [1, 2])
    assert r.reassign("t", 0, 2) == 1 and r.table(spark).count() == 2
    with pytest.raises(admin.LogError):
        r.require_self("t", 0)


def test_analytics(spark):
    rec = spark.createDataFrame([("t", 0, o, "v") for o in (0, 1, 3)], "topic string, part int, off long, v string")
    assert analytics.contiguity(rec).first().contiguous is False
    shuffled = rec.orderBy(F.desc("off"))
    digest = lambda d: analytics.digest(d, F.col("part"), F.col("off"), F.col("v").cast("binary")).first().digest
    want = 0xCBF29CE484222325
    for o in (0, 1, 3):
        h, r = fnv1a_int(struct.pack(">Iq", 0, o) + b"v"), o % 63 + 1
        want ^= (h << r | h >> (64 - r)) % (1 << 64)
    assert digest(rec) == digest(shuffled) == f"{want:016x}"
    assert [r.records for r in analytics.expected_counts(spark, 10, 4).orderBy("part").collect()] == [3, 3, 2, 2]
    assert analytics.equivalence(rec, rec).count() == 0
    seen = analytics.contiguity(rec)
    acked = spark.createDataFrame([("t", 0, 4), ("t", 1, 0)], "topic string, part int, acked long")
    assert {r.part: r.complete for r in analytics.no_lost_writes(seen, acked).collect()} == {0: False, 1: True}
    w = spark.createDataFrame([(v, "t", 0, 5) for v in "ab"] + [("a", "t", 1, 1), ("b", "t", 1, 2)], "view string, topic string, part int, hw long")
    assert tuple(analytics.hw_agreement(w).first()) == (2, 1, 7)
    l = spark.createDataFrame([(0, "t", 0, 5, 3), (1, "t", 0, 6, 2), (2, "t", 0, 6, 7)], "step int, topic string, part int, hw long, lso long")
    assert [r.step for r in analytics.lso_monotonic(l).orderBy("step").collect()] == [1, 2]
    k = spark.createDataFrame([("a/b", 3)], "t string, p int").select(sequencer.partition_key(F.col("t"), F.col("p")).alias("k"))
    assert k.select(sequencer.split_key(F.col("k")).alias("s")).select("s.*").first() == ("a/b", 3)


def mixed(x):
    """splitmix64 in Python."""
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def test_splitmix_and_rotation(spark):
    for v in (0, 1, 0xFFFFFFFFFFFFFFFF, 0x123456789ABCDEF0, 1 << 63):
        assert spark.range(1).select(hex64(mix64(constant(v))).alias("h")).first().h == f"{mixed(v):016x}"
        d = spark.range(64).select("id", hex64(rotate_left(constant(v), F.col("id").cast("int"))).alias("h"))
        assert all(int(r.h, 16) == (v << r.id | v >> (64 - r.id)) % (1 << 64) for r in d.collect())


def test_generated_records(spark):
    d = spark.createDataFrame([(0, 0), (3, 7), (19, 1 << 40)], "p int, s long")
    p, q = F.col("p"), F.col("s")
    for r in d.select("p", "s", generated.record_key(p, q).alias("k"), generated.record_value(p, q, 40).alias("v"), generated.record_value(p, q, 33, fast=True).alias("f"), generated.record_value(p, q, 28).alias("h")).collect():
        seed = mixed(r.p << 32 ^ r.s)
        head = b"LOGWEIR1" + struct.pack(">IqQ", r.p, r.s, seed)
        assert bytes(r.k) == struct.pack(">Iq", r.p, r.s) and bytes(r.h) == head
        assert bytes(r.v) == head + bytes(mixed(seed ^ i) & 255 for i in range(12)) and bytes(r.f) == head + bytes([seed & 255]) * 5
    back = d.select("p", "s", generated.parse_key(generated.record_key(p, q)).alias("k"), generated.parse_value(generated.record_value(p, q, 30)).alias("v")).collect()
    assert all((r.k.part, r.k.seq, r.v.part, r.v.seq) == (r.p, r.s, r.p, r.s) for r in back)
    with pytest.raises(ValueError):
        generated.record_value(p, q, 27)


def test_previous_and_numbers(spark):
    rows = [("a", i * 5) for i in range(40)] + [("b", 3), ("c", 1), ("c", 100)]
    d = spark.createDataFrame(rows, "k string, o long")
    got = {(r.k, r.o): r.p for r in previous(d, ["k"], ["o"], F.col("o"), F.floor(F.col("o") / 16), "p").collect()}
    assert got == {("a", i * 5): (i - 1) * 5 if i else None for i in range(40)} | {("b", 3): None, ("c", 1): None, ("c", 100): 1}
    n = numbered(spark.createDataFrame([("x", 10_000), ("y", 0), ("z", 1)], "k string, n long"), "n", "i")
    assert n.count() == 10_001 and n.where("k = 'x'").agg(F.sum("i"), F.max("i"), F.countDistinct("i")).first() == (10_000 * 9_999 // 2, 9_999, 10_000)


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 103: 100, 105: 100}


def plain_cuts(rows, policy):
    """Objects of one broker's batches (at, seq, bytes) in order."""
    out, opened, held, count, number = {}, None, 0, 0, -1
    for at, seq, size in rows:
        if opened is None or at - opened >= policy.linger_us or held >= policy.max_bytes or count >= policy.max_batches:
            opened, held, count, number = at, 0, 0, number + 1
        held, count = held + size, count + 1
        out[seq] = number
    return out


@pytest.mark.parametrize("policy", [flush.FlushPolicy(), flush.FlushPolicy(linger_us=50), flush.FlushPolicy(linger_us=400, max_bytes=90), flush.FlushPolicy(linger_us=10**9, max_batches=3)])
def test_flush_policy(spark, policy):
    import random

    rng = random.Random(1)
    rows, at = [], 0
    for i in range(400):
        at += rng.choice([0, 1, 9, 30, 200, 3_000_000_000])
        rows.append((i % 3, i, at, rng.randint(1, 40)))
    d = spark.createDataFrame(rows, "broker int, seq long, at long, bytes long")
    got = {r.seq: r.object for r in flush.cut_objects(d, policy).collect()}
    want = {}
    for b in range(3):
        want |= plain_cuts([r[2:3] + r[1:2] + r[3:] for r in rows if r[0] == b], policy)
    assert got == want and int(policy.stream_options()["maxRecordsPerFile"]) == policy.max_batches


def test_read_of_payloads(spark):
    one, two, three = payload(0, 2, 3), payload(0, 3), payload(0, 1) + payload(0, 4, 9)
    objects = spark.createDataFrame([(0, two + one), (1, three)], "commit_seq long, data binary")
    entries = spark.createDataFrame([(0, "t", 0, 10, 3, len(two), 0), (0, "t", 1, 0, 2, len(one), len(two)), (1, "t", 0, 13, 5, len(three), 0)], "commit_seq long, topic string, part int, base_offset long, record_count long, byte_len long, byte_start long")
    got = {r.part: (bytes(r.payload), r.next_offset) for r in views.fetch_payload(entries, objects, 0, 10**6).collect()}
    assert got == {0: (payload(10, 3) + payload(13, 1) + payload(14, 4, 9), 18), 1: (payload(0, 2, 3), 2)}
    assert {r.part: r.next_offset for r in views.fetch_payload(entries, objects, 11, 1).collect()} == {0: 13}
    assert views.fetch_payload(entries, objects, 18, 100).count() == 0
    with pytest.raises(ValueError, match="InvalidOffset"):
        views.check_start(4, 5)


def test_captured_ranges_and_fences(spark):
    ev = [(0, 1, "init"), (1, 1, "produce"), (2, 1, "produce"), (3, 1, "commit"), (4, 1, "produce"), (5, 1, "init"), (6, 1, "produce"), (7, 1, "init"), (8, 1, "produce"), (9, 2, "init"), (10, 2, "produce"), (11, 2, "abort")]
    d = spark.createDataFrame(ev, "seq long, producer long, kind string")
    rec = spark.createDataFrame([(s, "t", 0, 100 + s) for s, _, _ in ev], "event_id long, topic string, part int, off long")
    got = txn.ranges(d, rec)
    assert sorted((r.producer, r.init_seq, r.state, r.first_offset, r.last_offset, r.records) for r in got.collect()) == [(1, 0, "committed", 101, 102, 2), (1, 5, "discarded", 106, 106, 1), (1, 7, "open", 108, 108, 1), (2, 9, "aborted", 110, 110, 1)]
    assert [tuple(r) for r in txn.aborted_ranges(got, 110).collect()] == [(2, "t", 0, 110, 110)] and txn.aborted_ranges(got, 111).count() == 0
    asks = spark.createDataFrame([(0, 1, 1), (1, 1, 4), (2, 1, 6), (3, 2, 11), (4, 3, 0)], "commit_seq long, producer_id long, seq long")
    assert sorted((r.commit_seq, r.epoch) for r in txn.fence_epochs(d, asks).collect()) == [(0, 0), (2, 1)]


def test_cluster_and_partitions(spark):
    assert [tuple(r) for r in routing.cluster(spark, [(2, "b", 2), (1, "a", 1)], 2, "c").select("node_id", "is_self", "is_controller").orderBy("node_id").collect()] == [(1, False, True), (2, True, False)]
    for bad in ([(1, "a", 1)], [(2, "a", 1), (2, "b", 2)]):
        with pytest.raises(ValueError):
            routing.membership(bad, 2)
    d = spark.createDataFrame([(0, None, None), (1, None, "k"), (2, 5, "k"), (3, None, None), (4, None, "k"), (70_000, None, None)], "o long, e int, k string")
    got = {r.o: r.partition for r in routing.record_partition(d, 4, "e", "k", "o").collect()}
    assert (got[0], got[2], got[3], got[70_000]) == (0, 5, 1, 2) and got[1] == got[4] == fnv1a_int(b"k") % 4


def test_stub_groups(spark):
    log = spark.createDataFrame([(0, "g", "b", "join"), (1, "g", "a", "join"), (2, "g", "b", "join"), (3, "g", "b", "leave"), (4, "g", "b", "leave"), (5, "e", "x", "leave")], "seq long, grp string, member string, kind string")
    assert {r.grp: tuple(r)[1:] for r in groups.counted_joins(log).collect()} == {"g": (4, 1, "b"), "e": (0, 0, None)}


def test_catalogue_survives_a_lost_writer(spark, tmp_path, monkeypatch):
    c = admin.Catalog(spark, str(tmp_path / "cat"))
    c.create_topic("a", 2)

    def lost(self, name, version):
        raise RuntimeError("lost between data and pointer")

    with monkeypatch.context() as m:
        m.setattr(admin.Catalog, "_publish", lost)
        with pytest.raises(RuntimeError):
            c.create_topic("b", 1)
    again = admin.Catalog(spark, str(tmp_path / "cat"))
    assert [r.topic for r in again.topics().collect()] == ["a"]
    again.create_topic("c")
    assert [r.topic for r in again.topics().collect()] == ["a", "c"]
    for i in range(3):
        again.commit_offsets([(i, "g", "a", 0, 10 + i)])
    again.compact_offsets()
    again.commit_offsets([(3, "g", "a", 1, 5)])
    assert sorted(tuple(r) for r in again.offsets().collect()) == [("g", "a", 0, 12), ("g", "a", 1, 5)]
    assert sorted([again.init_producer_id(), c.init_producer_id(), again.init_producer_id()]) == [1, 2, 3]
    with pytest.raises(admin.LogError):
        again.get_or_create_topic("nowhere")
