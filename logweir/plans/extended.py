"""More of the catalogue: reads of payloads, flushes, transactions' ranges, replay checks, group rules, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames, payload
from ..functions.fnv import big_endian_32
from ..functions.prefix import exclusive_sum
from ..operators import analytics, compaction, flush, groups, loglayer, routing, sequencer, txn, views
from ..streaming import ingest
from .model import BAT, COM, FNV, IDEM, MEM, PST, REC, TXN

POLICY = flush.FlushPolicy(linger_us=900_000_000, max_bytes=2_000, max_batches=24)
BROKERS = [(3, "c", 9094), (1, "a", 9092), (2, "b", 9093)]
TOPICS = ["click", "error", "purchase", "signup", "view"]
SIZE = 32  # bytes of a replayed record


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _rec(spark, d):
    return loglayer.records(_t(spark, d, "events"))


def _bat(spark, d):
    return loglayer.event_batches(_t(spark, d, "events"))


def _hw(spark, d):
    return views.high_watermark(_bat(spark, d))


def _txn(spark, d):
    return txn.events_as_txn(_t(spark, d, "events"))


def _mem(spark, d):
    return groups.member_events(_t(spark, d, "events"))


def frame(base: Column, count: Column, body: Column) -> Column:
    """A record batch: its header as ``functions.frames`` reads it, and the body."""
    length = F.octet_length(body) + frames.HEADER - 12
    return F.concat(F.unhex(F.lpad(F.hex(base.cast("long")), 16, "0")), big_endian_32(length), F.unhex(F.lit("0000000002" + "00" * 40)), big_endian_32(count), body)


def _payload(spark, d):
    """Objects that hold the batches of ``events`` with offsets still 0; a read from offset 50 within 900 bytes."""
    b = _bat(spark, d).drop("byte_len")
    b = b.withColumn("data", frame(F.lit(0), F.col("record_count"), F.unhex(F.repeat(F.lpad(F.hex(F.col("commit_seq") % 256), 2, "0"), F.col("record_count").cast("int")))))
    b = exclusive_sum(b.withColumn("byte_len", F.octet_length("data").cast("long")), ["commit_seq"], ["topic", "part"], F.col("byte_len"), F.lit(0), "byte_start")
    parts = F.sort_array(F.collect_list(F.struct("byte_start", "data")))
    objects = b.groupBy("commit_seq").agg(F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["data"])), "")).alias("data"))
    return views.fetch_payload(b.drop("data"), objects, 50, 900).select("topic", "part", F.hex("payload").alias("payload"), "next_offset")


def _headers(spark, d):
    data = frame(F.col("o_custkey"), (F.col("o_orderkey") % 5).cast("int"), F.lit(b"\1"))
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit(b"short")).otherwise(data).alias("data"))
    return o.select("o_orderkey", frames.record_count(F.col("data")).alias("records"), F.coalesce(frames.base_offset(F.col("data")), F.lit(-1)).alias("base"), F.coalesce(frames.base_offset(frames.stamp_first(F.col("data"), F.col("o_orderkey"))), F.lit(-1)).alias("stamped"))


def _replay(spark, d):
    """Generated records with one fault each by rule, replayed against what was acknowledged."""
    e = _rec(spark, d)
    place = F.lit(0)
    for i, t in enumerate(TOPICS):
        place = F.when(F.col("topic") == t, 4 * i).otherwise(place)
    e = e.select((place + F.col("part")).alias("part"), "off", F.col("event_id").alias("id"))
    n = e.groupBy("part").agg((F.count("*") - F.col("part") % 3).alias("n"))
    part, seq, kind = F.col("part"), F.col("off"), F.col("id") % 23
    key = F.when(kind == 1, F.lit(b"12345678901")).when(kind == 3, payload.record_key(part + 1, seq)).otherwise(payload.record_key(part, seq))
    e = e.withColumn("whole", payload.record_value(part, seq + F.when(kind == 4, 1).otherwise(0), SIZE))
    value = F.col("whole")
    value = F.when(kind == 2, F.lit(b"LOGWEIR1")).when(kind == 5, F.concat(F.substring(value, 1, 20), F.lit(b"\0" * 8), F.substring(value, 29, 4))).when(kind == 6, F.concat(F.substring(value, 1, 28), F.lit(b"\0\1\2\3"))).otherwise(value)
    c = e.where(kind != 7).select("part", "off", key.alias("key"), value.alias("value"), "id")
    again = c.where(F.col("id") % 29 == 0).withColumn("off", 10_000_000_000 + F.col("id"))
    return analytics.replay_records(c.unionAll(again).drop("id"), n, SIZE, 20).withColumn("off", F.coalesce("off", F.lit(-1)))


def _shared(spark: SparkSession, name: str) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{found or spark.conf.get('spark.sql.warehouse.dir').rstrip('/') + '/_streams'}/{name}-{uuid.uuid4().hex}"


def _stream(spark, d):
    return ingest.read_events(spark, f"{d.rstrip('/')}/events.parquet")


def _ingested(spark, d):
    folder = _shared(spark, "ingest")
    q = _stream(spark, d).writeStream.foreachBatch(ingest.commit_to(f"{folder}/log")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return ingest.CommitLog(spark, f"{folder}/log").read().select("event_id", "topic", "part", "off")


def _windows(make, name: str):
    def run(spark, d):
        out = ingest.run_to_files(make(_stream(spark, d)), _shared(spark, name))
        out = out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end") if c in out.columns})
        return out.withColumn("total", F.round("total", 2)) if "total" in out.columns else out

    return run


def _deduplicated(spark, d):
    from .catalog import idempotent_batches

    folder = _shared(spark, "dedup")
    b = idempotent_batches(_t(spark, d, "orders")).where("producer_id >= 0")
    b.write.parquet(f"{folder}/in")
    return ingest.run_to_files(ingest.deduplicate(spark.readStream.schema(b.schema).parquet(f"{folder}/in")), folder)


def _epochs(spark, d):
    b = _bat(spark, d)
    e = b.groupBy("topic", "part", F.floor(F.col("commit_seq") / 40).cast("int").alias("epoch")).agg(F.min("base_offset").alias("start_offset"))
    asked = b.select("topic", "part").distinct().withColumn("epoch", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1, 2, 7)])))
    return views.leader_epoch_ends(e, _hw(spark, d), asked)


def _chosen(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select("o_orderkey", F.when(k % 10 == 0, (k % 4).cast("int")).alias("explicit"), F.when(k % 3 != 0, F.col("o_custkey")).alias("key"))
    return routing.record_partition(o, 6, "explicit", "key", "o_orderkey").select("o_orderkey", "partition")


def _metadata(spark, d):
    c = groups.commits(_rec(spark, d)).withColumns({"leader_epoch": (F.col("seq") % 7).cast("int"), "metadata": F.concat(F.lit("m"), F.col("seq").cast("string"))})
    return groups.latest_commits(c, ["committed", "leader_epoch", "metadata"])


def _acked(spark, d):
    return _t(spark, d, "events").groupBy(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part")).agg((F.count("*") - F.max("event_id") % 2).alias("acked"))


def _agreement(spark, d):
    hw = _hw(spark, d)
    other = hw.withColumn("hw", F.col("hw") + F.when((F.col("part") == 1) & (F.col("topic") == "view"), 1).otherwise(0))
    return analytics.hw_agreement(hw.withColumn("view", F.lit("a")).unionByName(other.withColumn("view", F.lit("b"))))


def _monotonic(spark, d):
    s = _bat(spark, d).select(F.col("commit_seq").alias("step"), "topic", "part", (F.col("base_offset") + F.col("record_count")).alias("hw"), (F.col("base_offset") + F.when(F.col("commit_seq") % 11 == 0, -9).otherwise(0)).alias("lso"))
    return analytics.lso_monotonic(s)


def _synced(spark, d):
    ask = groups.group_state(_mem(spark, d)).select("grp", F.col("generation").alias("now"))
    users = _t(spark, d, "events").select(F.col("event_type").alias("grp"), F.col("user_id").alias("member")).distinct()
    ask = users.join(ask, "grp").select("grp", "member", (F.col("now") - F.when(F.col("member") % 5 == 0, 1).otherwise(0)).alias("generation"))
    given = users.withColumn("assignment", F.concat(F.lit("p"), (F.col("member") % 4).cast("string")))
    return groups.sync(ask, _mem(spark, d), given)


def _recent(spark, d):
    from .catalog import idempotent_batches

    return sequencer.recent_batches(idempotent_batches(_t(spark, d, "orders")))


def _parts(spark, d):
    return _bat(spark, d).select("topic", "part").distinct()


def _described(spark, d):
    parts = _parts(spark, d).withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 4))).distinct()
    leaders = routing.partition_leader(parts, parts.where("part = 2").withColumns({"owner": F.lit(3), "leader_epoch": F.lit(4)}), [1, 2, 3], 1)
    cuts = _t(spark, d, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part"), F.floor(F.col("event_id") / 40).alias("off"))
    return views.describe_topics(parts, leaders, _hw(spark, d), views.log_start_offset(_bat(spark, d), cuts))


def _arrivals(spark, d):
    e = _t(spark, d, "events")
    return e.select((F.col("user_id") % 4).cast("int").alias("broker"), F.col("event_id").alias("seq"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"), (F.length("props") + 28).cast("long").alias("bytes"))


def _fences(spark, d):
    e = _t(spark, d, "events")
    return txn.fence_epochs(_txn(spark, d), e.select(F.floor(F.col("event_id") / 64).cast("long").alias("commit_seq"), F.col("user_id").alias("producer_id"), F.col("event_id").alias("seq")))


def queries() -> dict:
    return {
        "fetch_payload": _payload,
        "frame_headers": _headers,
        "flush_objects": lambda s, d: flush.cut_objects(_arrivals(s, d), POLICY),
        "flush_each": lambda s, d: flush.cut_objects(_arrivals(s, d), flush.FlushPolicy()),
        "txn_ranges": lambda s, d: txn.ranges(_txn(s, d), _rec(s, d)),
        "txn_aborted": lambda s, d: txn.aborted_ranges(txn.ranges(_txn(s, d), _rec(s, d)), 20),
        "txn_fence_epochs": _fences,
        "txn_expired": lambda s, d: txn.expired(_txn(s, d), 12_000, 2_100),
        "txn_markers": lambda s, d: txn.markers(txn.ranges(_txn(s, d), _rec(s, d))),
        "recent_batches": _recent,
        "insert_if_absent": lambda s, d: sequencer.insert_if_absent(_t(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v")), _t(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")), ["k"]),
        "partition_leader": lambda s, d: routing.partition_leader(_parts(s, d), _parts(s, d).where("part = 2").withColumns({"owner": F.lit(3), "leader_epoch": F.lit(4)}), [1, 2, 3], 1),
        "describe_topics": _described,
        "replay_records": _replay,
        "offset_for_leader_epoch": _epochs,
        "describe_cluster": lambda s, d: routing.cluster(s, BROKERS, 2, "logs"),
        "record_partition": _chosen,
        "stub_group_state": lambda s, d: groups.counted_joins(_mem(s, d)),
        "group_metadata": _metadata,
        "offset_fetch": lambda s, d: groups.fetch_response(groups.latest_offsets(groups.commits(_rec(s, d)))),
        "range_assignment": lambda s, d: groups.range_assignment(_mem(s, d), 16),
        "sync_group": _synced,
        "join_codes": lambda s, d: _t(s, d, "customer").select("c_custkey", groups.join_code(F.when(F.col("c_custkey") % 3 > 0, F.repeat("c_name", (F.col("c_custkey") % 3 - 1).cast("int")))).alias("code")),
        "watermark_or_zero": lambda s, d: views.with_absent(_t(s, d, "events").select(F.col("event_type").alias("topic")).distinct().withColumn("partitions", F.lit(6)), _hw(s, d), "hw"),
        "no_lost_writes": lambda s, d: analytics.no_lost_writes(analytics.contiguity(_rec(s, d)), _acked(s, d)),
        "exactly_once": lambda s, d: analytics.exactly_once(analytics.contiguity(_rec(s, d)), _acked(s, d)),
        "hw_agreement": _agreement,
        "lso_monotonic": _monotonic,
        "expected_counts": lambda s, d: analytics.expected_counts(s, 1_000_003, 12),
        "store_equivalence": lambda s, d: analytics.equivalence(_rec(s, d).select("topic", "part", "off"), _rec(s, d).where("off <> 3").select("topic", "part", "off").unionAll(_rec(s, d).where("off = 5").select("topic", "part", "off"))),
        "compacted_records": lambda s, d: compaction.latest_records(_rec(s, d).select("topic", "part", "user_id", "off", "event_id", "value"), "user_id"),
        "stream_ingest": _ingested,
        "stream_tumbling": _windows(ingest.tumbling, "tumbling"),
        "stream_sliding": _windows(ingest.sliding, "sliding"),
        "stream_sessions": _windows(ingest.sessions, "sessions"),
        "stream_dedup": _deduplicated,
    }


def oracle_sql() -> dict[str, str]:
    late = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
    topic = " ".join(f"WHEN '{t}' THEN {4 * i}" for i, t in enumerate(TOPICS))
    ranges = f"""{REC}, {TXN}, lastend AS (SELECT *, max(CASE WHEN kind IN ('commit','abort') THEN seq END) OVER (PARTITION BY producer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_seq FROM fin),
 rng AS (SELECT producer, init_seq, topic, part, CASE WHEN term IS NULL THEN 'open' WHEN term = 'init' THEN 'discarded' WHEN term = 'commit' THEN 'committed' ELSE 'aborted' END AS state,
 min(off) AS first_offset, max(off) AS last_offset, count(*) AS records FROM lastend l JOIN rec ON l.seq = rec.event_id
 WHERE kind = 'produce' AND init_seq IS NOT NULL AND (end_seq IS NULL OR end_seq < init_seq) GROUP BY ALL)"""
    arrivals = "arr AS (SELECT CAST(user_id % 4 AS INTEGER) AS broker, event_id AS seq, epoch_us(ts) AS us, length(props) + 28 AS bytes, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS rn FROM events)"
    seen = f"{REC}, con AS (SELECT topic, part, count(*) AS n, min(off) AS lo, max(off) AS hi FROM rec GROUP BY ALL), ack AS (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS part, count(*) - max(event_id) % 2 AS acked FROM events GROUP BY ALL)"
    return {
        "fetch_payload": f"""WITH {BAT}, p AS (SELECT topic, part, commit_seq, base_offset, record_count, printf('%016X', base_offset) || printf('%08X', record_count + 49) || '0000000002' || repeat('00', 40) || printf('%08X', record_count) || repeat(printf('%02X', commit_seq % 256), record_count) AS data FROM bat),
 r AS (SELECT *, length(data) // 2 AS n, sum(length(data) // 2) OVER (PARTITION BY topic, part ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM p WHERE base_offset + record_count > 50)
 SELECT topic, part, string_agg(data, '' ORDER BY base_offset) AS payload, max(base_offset + record_count) AS next_offset FROM r WHERE run <= 900 OR run = n GROUP BY ALL""",
        "frame_headers": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE greatest(1, o_orderkey % 5) END AS INTEGER) AS records, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey ELSE -1 END AS base, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey ELSE -1 END AS stamped FROM orders",
        "flush_objects": f"""WITH RECURSIVE {arrivals}, st(broker, rn, seq, opened, held, cnt, object) AS (SELECT broker, rn, seq, us, bytes, 1, CAST(0 AS BIGINT) FROM arr WHERE rn = 1
 UNION ALL SELECT a.broker, a.rn, a.seq, CASE WHEN x.cut THEN a.us ELSE s.opened END, CASE WHEN x.cut THEN a.bytes ELSE s.held + a.bytes END, CASE WHEN x.cut THEN 1 ELSE s.cnt + 1 END, s.object + CASE WHEN x.cut THEN 1 ELSE 0 END
 FROM st s JOIN arr a ON a.broker = s.broker AND a.rn = s.rn + 1, LATERAL (SELECT a.us - s.opened >= {POLICY.linger_us} OR s.held >= {POLICY.max_bytes} OR s.cnt >= {POLICY.max_batches} AS cut) x)
 SELECT broker, seq, object FROM st""",
        "flush_each": f"WITH {arrivals} SELECT broker, seq, rn - 1 AS object FROM arr",
        "txn_ranges": f"WITH {ranges} SELECT * FROM rng",
        "txn_aborted": f"WITH {ranges} SELECT producer, topic, part, first_offset, last_offset FROM rng WHERE state = 'aborted' AND last_offset >= 20",
        "txn_fence_epochs": f"""WITH {TXN}, m AS (SELECT *, CAST(sum(CASE WHEN kind = 'init' THEN 1 ELSE 0 END) OVER (PARTITION BY producer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS INTEGER) AS epoch,
 max(CASE WHEN kind IN ('commit','abort') THEN seq END) OVER (PARTITION BY producer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_seq FROM ends)
 SELECT CAST(floor(seq / 64) AS BIGINT) AS commit_seq, producer AS producer_id, max(epoch) AS epoch FROM m WHERE init_seq IS NOT NULL AND (end_seq IS NULL OR end_seq < init_seq) GROUP BY ALL""",
        "txn_expired": f"WITH {TXN}, o AS (SELECT producer, max(seq) AS init_seq FROM txn WHERE kind IN ('init','commit','abort') GROUP BY producer HAVING arg_max(kind, seq) = 'init') SELECT * FROM o WHERE 12000 - init_seq > 2100",
        "txn_markers": f"WITH {ranges} SELECT producer, init_seq, topic, part, last_offset + 1 AS after, CAST(CASE WHEN state = 'committed' THEN 1 ELSE 0 END AS INTEGER) AS type FROM rng WHERE state IN ('committed', 'aborted')",
        "recent_batches": f"""WITH {IDEM}, f AS (SELECT producer_id, topic, partition, producer_epoch, base_sequence, min(commit_seq) AS commit_seq, arg_min(batch_idx, commit_seq * 10 + batch_idx) AS idx FROM idem WHERE producer_id >= 0 GROUP BY ALL)
 SELECT producer_id, topic, partition, producer_epoch, base_sequence, commit_seq, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY producer_id, topic, partition, producer_epoch ORDER BY commit_seq DESC, idx DESC) AS r FROM f) WHERE r <= 5""",
        "insert_if_absent": "SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY o_custkey",
        "partition_leader": f"WITH keyed AS (SELECT DISTINCT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS part, hex(encode(event_type)) || printf('%08X', CAST(user_id % 4 AS INTEGER)) AS hx FROM events), {FNV} SELECT topic, part, CAST(CASE WHEN part = 2 THEN 3 ELSE h % 3 + 1 END AS INTEGER) AS leader, CAST(CASE WHEN part = 2 THEN 4 ELSE 0 END AS INTEGER) AS leader_epoch FROM hashed",
        "describe_topics": f"""WITH {BAT}, keyed AS (SELECT topic, CAST(part + k AS INTEGER) AS part, hex(encode(topic)) || printf('%08X', part + k) AS hx FROM (SELECT DISTINCT topic, part FROM bat), (SELECT unnest([0, 4]) AS k)), {FNV},
 h AS (SELECT topic, part, max(base_offset + record_count) AS hw FROM bat GROUP BY ALL), c AS (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS part, max(CAST(floor(event_id / 40) AS BIGINT)) AS cut FROM events GROUP BY ALL)
 SELECT topic, part, CAST(CASE WHEN part = 2 THEN 3 ELSE h % 3 + 1 END AS INTEGER) AS leader, CAST(CASE WHEN part = 2 THEN 4 ELSE 0 END AS INTEGER) AS leader_epoch, coalesce(hw, 0) AS hw, coalesce(cut, 0) AS log_start FROM hashed LEFT JOIN h USING (topic, part) LEFT JOIN c USING (topic, part)""",
        "replay_records": f"""WITH {REC}, e AS (SELECT CAST(CASE topic {topic} END + part AS INTEGER) AS part, off, event_id AS id, event_id % 23 AS kind, off AS seq FROM rec),
 n AS (SELECT part, count(*) - part % 3 AS n FROM e GROUP BY part), c AS (SELECT part, off, seq, kind FROM e WHERE kind <> 7 UNION ALL SELECT part, 10000000000 + id, seq, kind FROM e WHERE kind <> 7 AND id % 29 = 0),
 f AS (SELECT c.part, off, seq, c.kind, CASE c.kind WHEN 1 THEN 'invalid_key' WHEN 2 THEN 'invalid_value' WHEN 3 THEN 'partition_mismatch' WHEN 4 THEN 'sequence_mismatch' ELSE CASE WHEN seq >= n THEN 'unacknowledged' END END AS fault FROM c JOIN n USING (part)),
 s AS (SELECT *, row_number() OVER (PARTITION BY part, seq ORDER BY off) AS rn FROM f WHERE fault IS NULL), o AS (SELECT *, lag(off) OVER (PARTITION BY part ORDER BY off) AS prev FROM s WHERE rn = 1)
 SELECT part, off, fault AS kind FROM f WHERE fault IS NOT NULL UNION ALL SELECT part, off, 'duplicate' FROM s WHERE rn > 1 UNION ALL SELECT part, off, 'offset_gap' FROM o WHERE off <> coalesce(prev + 1, 0)
 UNION ALL SELECT part, off, CASE kind WHEN 5 THEN 'seed_mismatch' ELSE 'payload_mismatch' END FROM o WHERE kind IN (5, 6)
 UNION ALL SELECT e.part, -1, 'missing' FROM e JOIN n USING (part) WHERE seq < n AND kind IN (1, 2, 3, 4, 7)""",
        "offset_for_leader_epoch": f"""WITH {PST}, ep AS (SELECT topic, part, CAST(commit_seq // 40 AS INTEGER) AS known, min(base_offset) AS start FROM bat GROUP BY ALL),
 x AS (SELECT e.*, coalesce(lead(start) OVER (PARTITION BY e.topic, e.part ORDER BY known), hw) AS until FROM ep e JOIN pst p ON e.topic = p.topic AND e.part = p.part),
 a AS (SELECT topic, part, epoch FROM (SELECT DISTINCT topic, part FROM bat), (SELECT unnest([-1, 0, 1, 2, 7]) AS epoch))
 SELECT a.topic, a.part, CAST(a.epoch AS INTEGER) AS epoch, coalesce(max(known), -1) AS end_epoch, coalesce(max(until), -1) AS end_offset FROM a LEFT JOIN x ON a.topic = x.topic AND a.part = x.part AND known <= a.epoch GROUP BY ALL""",
        "describe_cluster": "SELECT CAST(n AS INTEGER) AS node_id, h AS host, CAST(p AS INTEGER) AS port, 'logs' AS cluster_id, n = 2 AS is_self, n = 1 AS is_controller FROM (VALUES (1, 'a', 9092), (2, 'b', 9093), (3, 'c', 9094)) t(n, h, p)",
        "record_partition": f"""WITH keyed AS (SELECT o_orderkey, o_orderkey % 10 = 0 AS given, o_orderkey % 3 = 0 AS none, hex(encode(CAST(o_custkey AS VARCHAR))) AS hx FROM orders), {FNV},
 t AS (SELECT *, sum(CASE WHEN none AND NOT given THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN none AND NOT given THEN 1 ELSE 0 END AS turn FROM hashed)
 SELECT o_orderkey, CAST(CASE WHEN given THEN o_orderkey % 4 WHEN none THEN turn % 6 ELSE h % 6 END AS INTEGER) AS partition FROM t""",
        "stub_group_state": f"""WITH {MEM}, e AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY grp, member ORDER BY seq), 'leave') AS prev FROM mem)
 SELECT grp, coalesce(generation, 0) AS generation, coalesce(members, 0) AS members, first_member FROM (SELECT DISTINCT grp FROM mem)
 LEFT JOIN (SELECT grp, count(*) AS generation, arg_min(member, seq) FILTER (kind = 'join') AS first_member FROM e WHERE kind = 'join' OR prev = 'join' GROUP BY grp) USING (grp) LEFT JOIN (SELECT grp, count(*) AS members FROM cur GROUP BY grp) USING (grp)""",
        "group_metadata": f"WITH {REC}, {COM} SELECT grp, topic, part, arg_max(committed, seq) AS committed, CAST(max(seq) % 7 AS INTEGER) AS leader_epoch, 'm' || max(seq) AS metadata FROM com GROUP BY ALL",
        "offset_fetch": f"WITH {REC}, {COM} SELECT *, -1 AS leader_epoch, CAST(0 AS BIGINT) AS timestamp FROM glast",
        "range_assignment": f"WITH {MEM}, m AS (SELECT grp, member, row_number() OVER (PARTITION BY grp ORDER BY member) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM cur) SELECT grp, CAST(p AS INTEGER) AS part, member FROM m, (SELECT range AS p FROM range(16)) WHERE p % n = r",
        "sync_group": f"""WITH {MEM}, u AS (SELECT DISTINCT event_type AS grp, user_id AS member FROM events), a AS (SELECT u.grp, u.member, generation - CASE WHEN u.member % 5 = 0 THEN 1 ELSE 0 END AS generation, generation AS now FROM u JOIN gst g ON g.grp = u.grp),
 h AS (SELECT a.*, CAST(CASE WHEN a.generation <> now THEN 22 WHEN c.member IS NULL THEN 25 ELSE 0 END AS INTEGER) AS code FROM a LEFT JOIN cur c ON c.grp = a.grp AND c.member = a.member) SELECT grp, member, generation, code, CASE WHEN code = 0 THEN 'p' || (member % 4) END AS assignment FROM h""",
        "join_codes": "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 < 2 THEN 79 ELSE 0 END AS INTEGER) AS code FROM customer",
        "watermark_or_zero": f"WITH {BAT}, h AS (SELECT topic, part, max(base_offset + record_count) AS hw FROM bat GROUP BY ALL), p AS (SELECT topic, CAST(p AS INTEGER) AS part FROM (SELECT DISTINCT topic FROM bat), (SELECT range AS p FROM range(6))) SELECT topic, part, coalesce(hw, 0) AS hw FROM p LEFT JOIN h USING (topic, part)",
        "no_lost_writes": f"WITH {seen} SELECT topic, part, coalesce(n, 0) AS n, acked, coalesce(n, 0) >= acked AS complete, n < hi - lo + 1 AS gap FROM con FULL JOIN ack USING (topic, part)",
        "exactly_once": f"WITH {seen} SELECT topic, part, n = acked AND n = hi - lo + 1 AS exact FROM con FULL JOIN ack USING (topic, part)",
        "hw_agreement": f"WITH {BAT}, h AS (SELECT topic, part, max(base_offset + record_count) AS hw, topic = 'view' AND part = 1 AS off FROM bat GROUP BY ALL) SELECT count(*) AS partitions, CAST(sum(CASE WHEN off THEN 1 ELSE 0 END) AS BIGINT) AS disagreeing, CAST(sum(hw + CASE WHEN off THEN 1 ELSE 0 END) AS BIGINT) AS total FROM h",
        "lso_monotonic": f"WITH {BAT}, s AS (SELECT commit_seq AS step, topic, part, base_offset + record_count AS hw, base_offset - CASE WHEN commit_seq % 11 = 0 THEN 9 ELSE 0 END AS lso FROM bat), p AS (SELECT *, lag(lso) OVER (PARTITION BY topic, part ORDER BY step) AS prev FROM s) SELECT step, topic, part, hw, lso FROM p WHERE lso < prev OR lso > hw",
        "expected_counts": "SELECT CAST(range AS INTEGER) AS part, CAST(1000003 // 12 + CASE WHEN range < 1000003 % 12 THEN 1 ELSE 0 END AS BIGINT) AS records FROM range(12)",
        "store_equivalence": f"WITH {REC} SELECT topic, part, off, 'a' AS side FROM rec WHERE off = 3 UNION ALL SELECT topic, part, off, 'b' FROM rec WHERE off = 5",
        "compacted_records": f"WITH {REC} SELECT topic, part, user_id, max(off) AS off, arg_max(event_id, off) AS event_id, arg_max(value, off) AS value FROM rec GROUP BY ALL",
        "stream_ingest": f"WITH {REC} SELECT event_id, topic, part, off FROM rec",
        "stream_tumbling": f"WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= {late}",
        "stream_sliding": f"WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start, event_type FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL HAVING start + INTERVAL 1 HOUR <= {late}",
        "stream_sessions": f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
 SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {late}""",
    }
