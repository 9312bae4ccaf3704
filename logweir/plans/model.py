"""SQL of the log model over ``events``, and of FNV-1a."""

# The log model over ``events`` as common table expressions.
REC = """rec AS (SELECT event_id, event_type AS topic, CAST(user_id % 4 AS INTEGER) AS part, user_id, ts, value,
 CAST(row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS off,
 CAST(floor(event_id / 64) AS BIGINT) AS commit_seq, CAST(length(props) + 28 AS BIGINT) AS nbytes FROM events)"""
BAT = REC + """, bat AS (SELECT commit_seq, topic, part, min(off) AS base_offset, count(*) AS record_count,
 CAST(sum(nbytes) AS BIGINT) AS byte_len FROM rec GROUP BY ALL)"""
ST = BAT + """, st AS (SELECT *, CASE WHEN commit_seq = (SELECT max(commit_seq) FROM bat) THEN 'open'
 WHEN commit_seq % 7 = 3 THEN 'aborted' ELSE 'committed' END AS state FROM bat)"""
PST = ST + """, pst AS (SELECT topic, part, max(base_offset + record_count) AS hw,
 coalesce(min(CASE WHEN state = 'open' THEN base_offset END), max(base_offset + record_count)) AS lso FROM st GROUP BY ALL)"""
COM = """com AS (SELECT event_id AS seq, CAST(user_id % 3 AS INTEGER) AS grp, topic, part, off + 1 AS committed FROM rec WHERE event_id % 5 = 0),
 glast AS (SELECT grp, topic, part, arg_max(committed, seq) AS committed FROM com GROUP BY ALL)"""
TXN = """txn AS (SELECT event_id AS seq, user_id AS producer, CASE event_type WHEN 'signup' THEN 'init' WHEN 'purchase' THEN 'commit'
 WHEN 'error' THEN 'abort' WHEN 'view' THEN 'produce' WHEN 'click' THEN 'stage' END AS kind FROM events),
 ends AS (SELECT *, max(CASE WHEN kind = 'init' THEN seq END) OVER (PARTITION BY producer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS init_seq,
 min(CASE WHEN kind IN ('init','commit','abort') THEN seq END) OVER (PARTITION BY producer ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS term_seq FROM txn),
 fin AS (SELECT e.*, t.kind AS term FROM ends e LEFT JOIN txn t ON t.seq = e.term_seq)"""
MEM = """mem AS (SELECT event_id AS seq, event_type AS grp, user_id AS member, CASE WHEN event_id % 3 = 0 THEN 'leave' ELSE 'join' END AS kind FROM events),
 meff AS (SELECT * FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY grp, member ORDER BY seq), 'leave') AS prev FROM mem) WHERE kind <> prev),
 cur AS (SELECT grp, member FROM mem GROUP BY ALL HAVING arg_max(kind, seq) = 'join'),
 gst AS (SELECT g.grp, coalesce(e.generation, 0) AS generation, coalesce(c.members, 0) AS members, c.leader FROM (SELECT DISTINCT grp FROM mem) g
 LEFT JOIN (SELECT grp, count(*) AS generation FROM meff GROUP BY grp) e USING (grp)
 LEFT JOIN (SELECT grp, count(*) AS members, min(member) AS leader FROM cur GROUP BY grp) c USING (grp))"""
# Synthetic idempotent batches: a producer's batches of two records, every seventh one repeated at once, every fifth one
# followed by a retry of the producer's batch up to eight before it, and every thirteenth without a producer.
IDEM = """idem0 AS (SELECT o_orderkey AS commit_seq, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey % 97 END AS producer_id, o_orderpriority AS topic, CAST(o_custkey % 4 AS INTEGER) AS partition,
 CAST(CASE WHEN o_orderkey % 13 = 0 THEN -1 WHEN o_orderkey % 101 = 0 THEN 0 ELSE 1 END AS INTEGER) AS producer_epoch, o_orderkey AS k FROM orders),
 idem1 AS (SELECT *, CAST(CASE WHEN producer_id < 0 THEN -1 ELSE 2 * (row_number() OVER (PARTITION BY producer_id, topic, partition ORDER BY k) - 1) END AS INTEGER) AS base_sequence FROM idem0),
 idem AS (SELECT commit_seq, producer_id, topic, partition, producer_epoch, base_sequence, 0 AS batch_idx, 2 AS record_count FROM idem1
 UNION ALL SELECT commit_seq, producer_id, topic, partition, producer_epoch, base_sequence, 1, 2 FROM idem1 WHERE k % 7 = 0
 UNION ALL SELECT commit_seq, producer_id, topic, partition, producer_epoch, CAST(base_sequence - 2 * (k % 9) AS INTEGER), 2, 2 FROM idem1 WHERE k % 5 = 0 AND producer_id >= 0 AND base_sequence >= 2 * (k % 9))"""
FNV = """hashed AS (SELECT *, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(1, length(hx) // 2 + 1),
 lambda i: CAST((position(substr(hx, CAST(2 * i - 1 AS INTEGER), 1) IN '0123456789ABCDEF') - 1) * 16 + position(substr(hx, CAST(2 * i AS INTEGER), 1) IN '0123456789ABCDEF') - 1 AS HUGEINT))),
 lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM keyed)"""
