"""Table schemas of the log model, as DDL: plain text needs no session where it is imported."""

BATCHES = "commit_seq BIGINT, batch_idx INT, object_id STRING, topic STRING, partition INT, producer_id BIGINT, producer_epoch INT, base_sequence INT, record_count INT, byte_start BIGINT, byte_len BIGINT"
GROUP_OFFSETS = "seq BIGINT, group_id STRING, topic STRING, partition INT, offset BIGINT"
BROKERS = "node_id INT, host STRING, port INT"
TOPICS = "topic STRING, partitions INT"


def names(ddl: str) -> list[str]:
    """Column names of a schema of plain columns."""
    return [c.split()[0] for c in ddl.split(", ")]
