"""The query catalogue: one entry per operator, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admin, analytics, compaction, groups, loglayer, routing, sequencer, txn, views
from . import extended
from .model import BAT, COM, FNV, IDEM, MEM, PST, REC, ST, TXN

NODES = [1, 2, 3]
TS = "2024-01-01 12:00:00"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _ev(spark, d):
    return _t(spark, d, "events")


def _rec(spark, d):
    return loglayer.records(_ev(spark, d))


def _bat(spark, d):
    return loglayer.event_batches(_ev(spark, d))


def _st(spark, d):
    return loglayer.with_state(_bat(spark, d))


def _pst(spark, d):
    return loglayer.partition_state(_st(spark, d))


def _txn(spark, d):
    return txn.events_as_txn(_ev(spark, d))


def _latest(spark, d):
    return groups.latest_offsets(groups.commits(_rec(spark, d)))


def _mem(spark, d):
    return groups.member_events(_ev(spark, d))


def idempotent_batches(orders: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    k, plain = F.col("o_orderkey"), F.col("o_orderkey") % 13 == 0
    d = orders.select(
        k.alias("commit_seq"), F.when(plain, -1).otherwise(F.col("o_custkey") % 97).alias("producer_id"), F.col("o_orderpriority").alias("topic"), (F.col("o_custkey") % 4).cast("int").alias("partition"),
        F.when(plain, -1).when(k % 101 == 0, 0).otherwise(1).cast("int").alias("producer_epoch"),
    )
    place = F.row_number().over(Window.partitionBy("producer_id", "topic", "partition").orderBy("commit_seq")) - 1
    d = d.withColumn("base_sequence", F.when(F.col("producer_id") < 0, -1).otherwise(2 * place).cast("int"))
    k, back = F.col("commit_seq"), (2 * (F.col("commit_seq") % 9)).cast("int")
    tail = lambda x, i: x.withColumns({"batch_idx": F.lit(i), "record_count": F.lit(2)})
    late = d.where((k % 5 == 0) & (F.col("producer_id") >= 0) & (F.col("base_sequence") >= back)).withColumn("base_sequence", F.col("base_sequence") - back)
    return tail(d, 0).unionAll(tail(d.where(k % 7 == 0), 1)).unionAll(tail(late, 2))


def _idem(spark, d):
    return idempotent_batches(_t(spark, d, "orders"))


def _exact(spark, d):
    """The whole orders table as objects of one to three batches."""
    b = _idem(spark, d).withColumn("object_id", F.concat(F.lit("o"), F.col("commit_seq").cast("string")))
    topics = b.select("topic").distinct().withColumn("partitions", F.lit(4))
    return sequencer.commit_exact(b, topics).drop("object_id")


def _requests(spark, d):
    return _ev(spark, d).select(F.col("event_type").alias("grp"), F.col("user_id").alias("member"), (F.col("event_id") % 2000).alias("generation"))


def _conv(spark, d):
    c = _t(spark, d, "conversations")
    seen = c.select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.xxhash64("text").alias("place"))
    n = c.groupBy(F.col("conv_id").alias("key")).agg((F.countDistinct("turn") + F.col("key") % 3 - 1).alias("n"))
    return analytics.replay_proof(seen, n).groupBy("key", "seq", "kind").agg(F.count("*").alias("times"))


def _parts(spark, d):
    return _bat(spark, d).select("topic", "part").distinct()


def _truncations(spark, d):
    return _ev(spark, d).select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part"), F.floor(F.col("event_id") / 40).alias("off"))


def queries() -> dict:
    return extended.queries() | {
        "offset_assign": lambda s, d: _rec(s, d).select("event_id", "topic", "part", "off", "commit_seq", "nbytes"),
        "prefix_sum_equals_base": lambda s, d: sequencer.commit_fast(loglayer.batches(_rec(s, d)).withColumnRenamed("part", "partition").withColumnRenamed("base_offset", "want").withColumn("batch_idx", F.lit(0))).agg(F.sum((F.col("base_offset") != F.col("want")).cast("long")).alias("mismatches")),
        "object_index": lambda s, d: loglayer.object_index(_bat(s, d)),
        "high_watermark": lambda s, d: views.high_watermark(_bat(s, d)),
        "log_start_offset": lambda s, d: views.log_start_offset(_bat(s, d), _truncations(s, d)),
        "index_lookup": lambda s, d: views.index_lookup(_bat(s, d), 200),
        "fetch_budget": lambda s, d: views.fetch(_bat(s, d), 50, 600),
        "list_offsets_ts": lambda s, d: views.list_offsets(_rec(s, d), TS),
        "truncate": lambda s, d: views.truncate(_bat(s, d), 100),
        "last_stable_offset": lambda s, d: _pst(s, d),
        "aborted_lookup": lambda s, d: views.aborted_lookup(_st(s, d), 100),
        "read_committed": lambda s, d: views.read_committed(_rec(s, d), _st(s, d), _pst(s, d)),
        "read_uncommitted": lambda s, d: views.read_uncommitted(_rec(s, d), _pst(s, d)),
        "txn_resolve": lambda s, d: txn.resolve(_txn(s, d)),
        "txn_offset_apply": lambda s, d: txn.apply_offsets(_txn(s, d)),
        "producer_epoch": lambda s, d: txn.epochs(_txn(s, d)),
        "open_transactions": lambda s, d: txn.open_transactions(_txn(s, d)),
        "txn_fencing": lambda s, d: txn.fence(_txn(s, d)),
        "idempotent_dedup": lambda s, d: sequencer.idempotent_dedup(_idem(s, d)),
        "fencing": lambda s, d: sequencer.fencing(_idem(s, d)),
        "sequence_gap": lambda s, d: sequencer.sequence_gap(_idem(s, d)),
        "commit_object_exact": _exact,
        "group_offsets": _latest,
        "consumer_lag": lambda s, d: views.lag(_pst(s, d), _latest(s, d)),
        "delete_group_offsets": lambda s, d: groups.delete_group(_latest(s, d), 1),
        "delete_offset": lambda s, d: groups.delete_offset(_latest(s, d), 0, "view", 2),
        "group_state": lambda s, d: groups.group_state(_mem(s, d)),
        "list_groups": lambda s, d: groups.list_groups(groups.group_state(_mem(s, d))),
        "heartbeat_check": lambda s, d: groups.heartbeat(_requests(s, d), _mem(s, d)),
        "leader_for": lambda s, d: routing.leader_for(_parts(s, d), NODES),
        "coordinator_for": lambda s, d: routing.coordinator_for(_t(s, d, "customer").select(F.col("c_name").alias("grp")), NODES),
        "leader_balance": lambda s, d: routing.leader_balance(_ev(s, d).select(F.col("event_type").alias("topic")).distinct(), NODES, 64),
        "contiguity": lambda s, d: analytics.contiguity(_rec(s, d)),
        "replay_proof": _conv,
        "nearest_rank_p99": lambda s, d: analytics.nearest_rank(_ev(s, d), "event_type", "value", "event_id", 0.99),
        "flush_cost": lambda s, d: analytics.flush_cost(_bat(s, d)),
        "cost_summary": lambda s, d: analytics.cost_summary(_bat(s, d)),
        "index_tiling": lambda s, d: analytics.index_tiling(_bat(s, d)),
        "log_dirs": lambda s, d: views.log_dirs(_bat(s, d)),
        "keep_latest_compaction": lambda s, d: compaction.keep_latest(_rec(s, d), "user_id"),
        "retention_by_time": lambda s, d: compaction.retention_by_time(_rec(s, d), 24),
        "retention_by_size": lambda s, d: compaction.retention_by_size(_bat(s, d), 20_000),
        "record_digest": lambda s, d: analytics.digest(_rec(s, d), F.col("part"), F.col("off"), F.col("user_id").cast("string").cast("binary")),
        "object_keys": lambda s, d: _t(s, d, "supplier").select("s_suppkey", loglayer.object_key(F.col("s_name"), F.col("s_suppkey"), F.col("s_nationkey"), F.lit(7)).alias("object_key")),
        "topic_catalogue": lambda s, d: _parts(s, d).groupBy("topic").agg((F.max("part") + 1).alias("partitions")),
        "capabilities": lambda s, d: admin.capabilities(s),
        "lineitem_offsets": lambda s, d: _lineitem(s, d),
    }


def _lineitem(spark, d):
    """A larger log: lineitem by ship mode flag, offsets by order and line."""
    li = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("topic"), (F.col("l_suppkey") % 4).cast("int").alias("part"), F.col("l_orderkey"), "l_linenumber", F.lit(1).alias("one"))
    from ..functions.prefix import exclusive_sum

    out = exclusive_sum(li, ["topic", "part"], ["l_orderkey", "l_linenumber"], F.col("one"), F.floor(F.col("l_orderkey") / 4096), "off")
    return out.groupBy("topic", "part").agg(F.max("off").alias("last"), F.sum(F.col("off") * (F.col("l_linenumber") % 3)).cast("long").alias("checksum"))


def oracle_sql() -> dict[str, str]:
    keyed = "keyed AS (SELECT DISTINCT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS part, hex(encode(event_type)) || printf('%08X', CAST(user_id % 4 AS INTEGER)) AS hx FROM events)"
    return extended.oracle_sql() | {
        "offset_assign": f"WITH {REC} SELECT event_id, topic, part, off, commit_seq, nbytes FROM rec",
        "prefix_sum_equals_base": f"WITH {BAT}, p AS (SELECT *, coalesce(sum(record_count) OVER (PARTITION BY topic, part ORDER BY commit_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM bat) SELECT CAST(sum(CASE WHEN run <> base_offset THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM p",
        "object_index": f"WITH {BAT} SELECT topic, part, commit_seq, base_offset, record_count, byte_len, base_offset + record_count AS end_offset FROM bat",
        "high_watermark": f"WITH {BAT} SELECT topic, part, max(base_offset + record_count) AS hw FROM bat GROUP BY ALL",
        "log_start_offset": f"WITH {BAT} SELECT b.topic, b.part, coalesce(t.cut, 0) AS log_start FROM (SELECT DISTINCT topic, part FROM bat) b LEFT JOIN (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS part, max(CAST(floor(event_id / 40) AS BIGINT)) AS cut FROM events GROUP BY ALL) t ON b.topic = t.topic AND b.part = t.part",
        "index_lookup": f"WITH {BAT} SELECT * FROM bat WHERE base_offset + record_count > 200",
        "fetch_budget": f"WITH {BAT}, r AS (SELECT *, CAST(sum(byte_len) OVER (PARTITION BY topic, part ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM bat WHERE base_offset + record_count > 50) SELECT * FROM r WHERE run <= 600 OR run = byte_len",
        "list_offsets_ts": f"WITH {REC} SELECT topic, part, min(off) AS off FROM rec WHERE ts >= TIMESTAMP '{TS}' GROUP BY ALL",
        "truncate": f"WITH {BAT} SELECT *, CAST(100 AS BIGINT) AS log_start FROM bat WHERE NOT (base_offset + record_count <= 100)",
        "last_stable_offset": f"WITH {PST} SELECT * FROM pst",
        "aborted_lookup": f"WITH {ST} SELECT topic, part, commit_seq, base_offset AS first_offset, base_offset + record_count - 1 AS last_offset FROM st WHERE state = 'aborted' AND base_offset + record_count - 1 >= 100",
        "read_committed": f"WITH {PST} SELECT event_id, r.topic, r.part, off FROM rec r JOIN pst p ON r.topic = p.topic AND r.part = p.part WHERE off < lso AND NOT EXISTS (SELECT 1 FROM st a WHERE a.state = 'aborted' AND a.topic = r.topic AND a.part = r.part AND r.off BETWEEN a.base_offset AND a.base_offset + a.record_count - 1)",
        "read_uncommitted": f"WITH {PST} SELECT event_id, r.topic, r.part, off FROM rec r JOIN pst p ON r.topic = p.topic AND r.part = p.part WHERE off < hw",
        "txn_resolve": f"WITH {TXN} SELECT seq, producer, CASE WHEN init_seq IS NULL THEN 'none' WHEN term IS NULL THEN 'open' WHEN term = 'init' THEN 'discarded' WHEN term = 'commit' THEN 'committed' ELSE 'aborted' END AS state FROM fin WHERE kind = 'produce'",
        "txn_offset_apply": f"WITH {TXN}, s AS (SELECT CAST(producer % 4 AS INTEGER) AS key, term_seq, seq, row_number() OVER (PARTITION BY producer % 4 ORDER BY term_seq DESC, seq DESC) AS rn FROM fin WHERE kind = 'stage' AND init_seq IS NOT NULL AND term = 'commit') SELECT key, term_seq, seq FROM s WHERE rn = 1",
        "producer_epoch": f"WITH {TXN} SELECT producer, count(CASE WHEN kind = 'init' THEN 1 END) - 1 AS epoch FROM txn GROUP BY producer",
        "open_transactions": f"WITH {TXN} SELECT producer, max(seq) AS init_seq FROM txn WHERE kind IN ('init','commit','abort') GROUP BY producer HAVING arg_max(kind, seq) = 'init'",
        "txn_fencing": f"WITH {TXN}, e AS (SELECT *, CAST(sum(CASE WHEN kind = 'init' THEN 1 ELSE 0 END) OVER (PARTITION BY producer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS epoch, CAST(sum(CASE WHEN kind = 'init' THEN 1 ELSE 0 END) OVER (PARTITION BY producer) - 1 AS BIGINT) AS now FROM txn) SELECT seq, producer, epoch, epoch < now AS fenced FROM e WHERE kind = 'produce'",
        "idempotent_dedup": f"""WITH {IDEM}, f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY producer_id, topic, partition, producer_epoch, base_sequence ORDER BY commit_seq, batch_idx) = 1 THEN 1 ELSE 0 END AS is_first FROM idem),
 p AS (SELECT *, sum(is_first) OVER (PARTITION BY producer_id, topic, partition, producer_epoch ORDER BY commit_seq, batch_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM f),
 o AS (SELECT producer_id AS pid, topic AS t, partition AS pn, producer_epoch AS e, base_sequence AS q, place AS origin FROM p WHERE is_first = 1)
 SELECT commit_seq, producer_id, topic, partition, producer_epoch, base_sequence, batch_idx, record_count, producer_id >= 0 AND is_first = 0 AND place - origin < 5 AS duplicate
 FROM p JOIN o ON pid = producer_id AND t = topic AND pn = partition AND e = producer_epoch AND q = base_sequence""",
        "fencing": f"WITH {IDEM} SELECT *, producer_id >= 0 AND coalesce(producer_epoch < max(producer_epoch) OVER (PARTITION BY producer_id, topic, partition ORDER BY commit_seq, batch_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS fenced FROM idem",
        "sequence_gap": f"WITH {IDEM} SELECT * FROM (SELECT *, coalesce(CAST(lag(base_sequence + record_count) OVER (PARTITION BY producer_id, topic, partition, producer_epoch ORDER BY commit_seq, batch_idx) AS BIGINT), 0) AS expected FROM idem) WHERE base_sequence <> expected AND producer_id >= 0",
        "group_offsets": f"WITH {REC}, {COM} SELECT * FROM glast",
        "consumer_lag": f"WITH {PST}, {COM} SELECT g.grp, g.topic, g.part, p.hw, g.committed, p.hw - g.committed AS lag FROM glast g JOIN pst p ON g.topic = p.topic AND g.part = p.part",
        "delete_group_offsets": f"WITH {REC}, {COM} SELECT * FROM glast WHERE grp <> 1",
        "delete_offset": f"WITH {REC}, {COM} SELECT * FROM glast WHERE NOT (grp = 0 AND topic = 'view' AND part = 2)",
        "group_state": f"WITH {MEM} SELECT * FROM gst",
        "list_groups": f"WITH {MEM} SELECT grp, CASE WHEN members > 0 THEN 'Stable' ELSE 'Empty' END AS state FROM gst",
        "heartbeat_check": f"WITH {MEM} SELECT r.grp, r.member, r.generation, CAST(CASE WHEN g.grp IS NULL THEN 16 WHEN r.generation <> g.generation THEN 22 WHEN c.member IS NULL THEN 25 ELSE 0 END AS INTEGER) AS code FROM (SELECT event_type AS grp, user_id AS member, event_id % 2000 AS generation FROM events) r LEFT JOIN gst g ON r.grp = g.grp LEFT JOIN cur c ON r.grp = c.grp AND r.member = c.member",
        "leader_for": f"WITH {keyed}, {FNV} SELECT topic, part, CAST(h % 3 + 1 AS INTEGER) AS leader FROM hashed",
        "coordinator_for": f"WITH keyed AS (SELECT c_name AS grp, hex(encode(c_name)) AS hx FROM customer), {FNV} SELECT grp, CAST(h % 3 + 1 AS INTEGER) AS coordinator FROM hashed",
        "leader_balance": f"WITH keyed AS (SELECT topic, p, hex(encode(topic)) || printf('%08X', p) AS hx FROM (SELECT DISTINCT event_type AS topic FROM events), (SELECT CAST(range AS INTEGER) AS p FROM range(64))), {FNV} SELECT topic, CAST(h % 3 + 1 AS INTEGER) AS leader, count(*) AS led, count(*) > 0 AND count(*) < 64 AS balanced FROM hashed GROUP BY ALL",
        "contiguity": f"WITH {REC} SELECT topic, part, count(*) AS n, min(off) AS lo, max(off) AS hi, count(*) = max(off) - min(off) + 1 AS contiguous FROM rec GROUP BY ALL",
        "nearest_rank_p99": "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = floor(0.99 * (n - 1) + 0.5)",
        "flush_cost": f"WITH {BAT} SELECT commit_seq, count(*) AS batches, CAST(sum(record_count) AS BIGINT) AS records, CAST(sum(byte_len) AS BIGINT) AS bytes FROM bat GROUP BY commit_seq",
        "replay_proof": """WITH seen AS (SELECT conv_id AS key, turn AS seq, row_number() OVER (PARTITION BY conv_id, turn) AS rn FROM conversations),
 e AS (SELECT key, count(DISTINCT seq) + key % 3 - 1 AS n FROM seen GROUP BY key),
 bad AS (SELECT key, seq, 'duplicate' AS kind FROM seen WHERE rn > 1
 UNION ALL SELECT s.key, seq, 'unexpected' FROM seen s JOIN e ON s.key = e.key WHERE seq < 0 OR seq >= n
 UNION ALL SELECT key, seq, 'missing' FROM (SELECT key, unnest(range(n)) AS seq FROM e) w WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.key = w.key AND s.seq = w.seq)
 UNION ALL SELECT key, seq, 'gap' FROM (SELECT key, seq, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev FROM seen) WHERE seq > prev + 1)
 SELECT key, seq, kind, count(*) AS times FROM bad GROUP BY ALL""",
        "cost_summary": f"WITH {BAT}, c AS (SELECT commit_seq, count(*) AS batches, sum(record_count) AS records, sum(byte_len) AS bytes FROM bat GROUP BY commit_seq), s AS (SELECT count(*) AS objects, CAST(sum(records) AS BIGINT) AS records, sum(bytes) AS bytes, sum(batches) AS batches FROM c) SELECT objects, records, CAST(bytes AS DOUBLE) / objects AS bytes_per_object, objects * CAST(1000000.0 AS DOUBLE) / records AS puts_per_million, CAST(batches AS DOUBLE) / objects AS batches_per_object, CAST(records AS DOUBLE) / objects AS coalescing FROM s",
        "capabilities": "SELECT true AS durable, true AS restart_safe, true AS idempotent, true AS transactions, true AS timestamps, true AS headers, 'parquet' AS compression, 'single writer' AS lease",
        "record_digest": f"""WITH {REC}, keyed AS (SELECT topic, part, off, printf('%08X', part) || printf('%016X', off) || hex(encode(CAST(user_id AS VARCHAR))) AS hx FROM rec), {FNV},
 r AS (SELECT topic, part, h, CAST(pow(2, off % 63 + 1) AS HUGEINT) AS up, CAST(pow(2, 63 - off % 63) AS HUGEINT) AS down FROM hashed)
 SELECT topic, part, lower(lpad(to_hex(CAST(xor(bit_xor((h * up) % 18446744073709551616 + h // down), CAST(14695981039346656037 AS HUGEINT)) AS UBIGINT)), 16, '0')) AS digest FROM r GROUP BY ALL""",
        "index_tiling": f"WITH {BAT} SELECT topic, part, commit_seq, base_offset, expected FROM (SELECT *, coalesce(lag(base_offset + record_count) OVER (PARTITION BY topic, part ORDER BY base_offset), 0) AS expected FROM bat) WHERE base_offset <> expected",
        "log_dirs": f"WITH {BAT} SELECT topic, part, CAST(sum(byte_len) AS BIGINT) AS bytes, count(*) AS batches FROM bat GROUP BY ALL",
        "keep_latest_compaction": f"WITH {REC} SELECT topic, part, user_id, max(off) AS off FROM rec GROUP BY ALL",
        "retention_by_time": f"WITH {REC}, n AS (SELECT topic, part, max(ts) AS newest FROM rec GROUP BY ALL) SELECT n.topic, n.part, coalesce(max(CASE WHEN r.ts < n.newest - INTERVAL 24 HOUR THEN r.off + 1 END), 0) AS log_start FROM n JOIN rec r ON r.topic = n.topic AND r.part = n.part GROUP BY n.topic, n.part",
        "retention_by_size": f"WITH {BAT}, r AS (SELECT *, sum(byte_len) OVER (PARTITION BY topic, part ORDER BY base_offset DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tail, max(base_offset) OVER (PARTITION BY topic, part) AS newest FROM bat) SELECT topic, part, min(base_offset) AS log_start FROM r WHERE tail <= 20000 OR base_offset = newest GROUP BY ALL",
        "object_keys": "SELECT s_suppkey, 'seg/' || regexp_replace(s_name, '[^A-Za-z0-9._-]', '-', 'g') || '-' || s_suppkey || '-' || s_nationkey || '-7/' AS object_key FROM supplier",
        "topic_catalogue": "SELECT event_type AS topic, CAST(max(user_id % 4) + 1 AS INTEGER) AS partitions FROM events GROUP BY event_type",
        "lineitem_offsets": "WITH r AS (SELECT l_returnflag AS topic, CAST(l_suppkey % 4 AS INTEGER) AS part, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_suppkey % 4 ORDER BY l_orderkey, l_linenumber) - 1 AS off FROM lineitem) SELECT topic, part, max(off) AS last, CAST(sum(off * (l_linenumber % 3)) AS BIGINT) AS checksum FROM r GROUP BY ALL",
    }
