import shutil
import time

import pytest
from pyspark.sql import functions as F

from logweir.operators import compaction, loglayer
from logweir.sources import logdir
from logweir.streaming import ingest

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_log_directory_source(spark, tmp_path):
    rec = loglayer.records(spark.read.parquet(EVENTS))
    path = str(tmp_path / "log")
    loglayer.write_log(rec, path)
    logdir.register(spark)
    got = spark.read.format("logdir").option("path", path).option("startOffset", 5).option("endOffset", 12).load()
    want = rec.where("off >= 5 AND off < 12")
    cols = ["event_id", "topic", "part", "off"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert spark.read.format("logdir").option("path", f"file://{path}").option("rowsPerTask", 7).load().count() == rec.count()
    assert spark.read.format("logdir").option("path", str(tmp_path / "nothing")).load().count() == 0
    stream = spark.readStream.format("logdir").option("path", path).option("maxOffsetsPerTrigger", 20).option("progress", str(tmp_path / "progress")).load()
    q = stream.writeStream.format("memory").queryName("logdir_all").trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("logdir_all").count() == rec.count()
    compaction.compact_files(spark, path, str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == rec.count()


@pytest.mark.parametrize("most", [None, 15])
def test_log_stream_after_a_restart(spark, tmp_path, most):
    """Stopped, started again, stopped in the middle and fed again: every record once."""
    rec = loglayer.records(spark.read.parquet(EVENTS)).cache()
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    logdir.register(spark)

    def run(batches=None):
        r = spark.readStream.format("logdir").option("path", path)
        if most:
            r = r.option("maxOffsetsPerTrigger", most).option("progress", str(tmp_path / "progress"))
        q = r.load().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        if batches is None:
            q.processAllAvailable()
        else:
            while len(q.recentProgress) < batches and q.isActive:
                pass
        q.stop()

    loglayer.write_log(rec.where("off < 30"), path)
    run(1)
    run()
    run()
    loglayer.write_log(rec.where("off >= 30"), path)
    run()
    run()
    got = spark.read.parquet(out)
    assert got.count() == got.select("event_id").distinct().count() == rec.count()
    rec.unpersist()


def contiguous(log):
    g = log.groupBy("topic", "part").agg(F.count("*").alias("n"), F.min("off").alias("lo"), F.max("off").alias("hi"), F.countDistinct("off").alias("d"))
    return all(r.n == r.d == r.hi + 1 and r.lo == 0 for r in g.collect())


def test_commits_are_exactly_once(spark, tmp_path, monkeypatch):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.read.parquet(EVENTS).repartitionByRange(4, "event_id").write.parquet(src)
    start = lambda cp: ingest.read_events(spark, src, 1).writeStream.foreachBatch(ingest.commit_to(log)).option("checkpointLocation", str(tmp_path / cp)).trigger(availableNow=True).start()
    start("cp").awaitTermination()
    commits = ingest.CommitLog(spark, log)
    assert contiguous(commits.read()) and commits.read().count() == 1000
    # the last batch again, as after a crash before the checkpoint knew of it
    last = commits.objects()[-1]
    again = spark.read.parquet(EVENTS).where("event_id >= 750").select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part"), "event_id", "user_id", "value")
    assert commits.commit(again, last) is False and commits.read().count() == 1000
    # a writer lost before its mark leaves nothing
    with monkeypatch.context() as m:
        m.setattr(ingest.loglayer, "numbered", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            commits.commit(again, "other-000000000000")
    assert commits.read().count() == 1000
    # another checkpoint appends, and replaces nothing
    start("second").awaitTermination()
    assert commits.read().count() == 2000 and contiguous(commits.read())
    with pytest.raises(ValueError):
        ingest.commit_to(log)(again, 0)
    shutil.rmtree(src)


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    batch = spark.read.parquet(EVENTS)
    batch.coalesce(1).write.parquet(src)
    got = ingest.run_once(ingest.tumbling(ingest.read_events(spark, src)), "tumbling_all", "complete")
    want = batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert sorted(map(tuple, got.select("start", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))


def test_stream_deduplication(spark, tmp_path):
    rows = [(i, 0, 7, "t", 0, 0, s, 1) for i, s in enumerate([0, 1, 1, 2, 5, 3, 0])] + [(9, 0, 7, "t", 0, 1, 0, 1), (10, 0, 7, "t", 0, 0, 4, 1)]
    schema = "commit_seq long, batch_idx int, producer_id long, topic string, partition int, producer_epoch int, base_sequence int, record_count int"
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    out = ingest.run_once(ingest.deduplicate(spark.readStream.schema(schema).parquet(src)), "dedup_all")
    got = [r.outcome for r in out.orderBy("commit_seq").collect()]
    assert got == ["Assigned", "Assigned", "Duplicate", "Assigned", "OutOfOrderSequence", "Assigned", "Duplicate", "Assigned", "InvalidProducerEpoch"]


def test_progress_table(spark, tmp_path):
    from logweir.streaming.metrics import Progress

    src = str(tmp_path / "in")
    spark.read.parquet(EVENTS).coalesce(1).write.parquet(src)
    seen = Progress()
    spark.streams.addListener(seen)
    try:
        ingest.run_once(ingest.read_events(spark, src), "watched")
        for _ in range(100):
            if "watched" in seen.last:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert {r.query: r.input_rows for r in seen.table(spark).collect()}["watched"] in (0, 1000) and 'stream_input_rows_total{query="watched"} 1000' in seen.text()
