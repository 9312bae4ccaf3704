"""Every catalogue query gives DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

from logweir.plans import catalog

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DIR).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_queries_without_sql(spark):
    """The exact fold is compared with its model in test_sequencer.py; the stream's fold is compared here, producer by producer."""
    assert sorted(set(QUERIES) - set(SQL)) == ["commit_object_exact", "stream_dedup"]
    batches = catalog.idempotent_batches(spark.read.parquet(f"{DIR}/orders.parquet")).where("producer_id >= 0").collect()
    want, state = {}, {}
    for b in sorted(batches, key=lambda b: (b.commit_seq, b.batch_idx)):
        epoch, nxt, recent = state.get((b.producer_id, b.topic, b.partition), (-1, 0, []))
        if b.producer_epoch == epoch and b.base_sequence in recent:
            what = "Duplicate"
        elif b.producer_epoch < epoch:
            what = "InvalidProducerEpoch"
        elif b.base_sequence != (nxt if b.producer_epoch == epoch else 0):
            what = "OutOfOrderSequence"
        else:
            recent = (recent if b.producer_epoch == epoch else [])[-4:] + [b.base_sequence]
            what, epoch, nxt = "Assigned", b.producer_epoch, b.base_sequence + b.record_count
        state[b.producer_id, b.topic, b.partition] = (epoch, nxt, recent)
        want.setdefault((b.commit_seq, b.base_sequence), []).append(what)
    got = {}
    for r in QUERIES["stream_dedup"](spark, DIR).collect():
        got.setdefault((r.commit_seq, r.base_sequence), []).append(r.outcome)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
