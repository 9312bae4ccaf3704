import random

import pytest

from logweir.operators import sequencer
from logweir.operators.sequencer import LogState


def batch(commit, idx=0, topic="t", partition=0, pid=-1, epoch=-1, seq=-1, count=1):
    return {"commit_seq": commit, "batch_idx": idx, "object_id": f"o{commit}", "topic": topic, "partition": partition, "producer_id": pid, "producer_epoch": epoch, "base_sequence": seq, "record_count": count, "byte_start": 0, "byte_len": 10 * count}


class Model:
    """Written apart from the engine: keeps whole histories and derives everything from them."""

    def __init__(self, known):
        self.known, self.accepted = known, []

    def hw(self, tp):
        return sum(b["record_count"] for b, _ in self.accepted if (b["topic"], b["partition"]) == tp)

    def commit(self, batches):
        new, out = [], []
        for b in batches:
            tp = (b["topic"], b["partition"])
            if tp not in self.known:
                return ["Rejected"] * len(batches)
            base = self.hw(tp) + sum(x["record_count"] for x, _ in new if (x["topic"], x["partition"]) == tp)
            if b["producer_id"] >= 0:
                mine = lambda rows: [(x, o) for x, o in rows if x["producer_id"] == b["producer_id"] and (x["topic"], x["partition"]) == tp]  # noqa: B023, E731
                old = [(x, o) for x, o in mine(self.accepted)]
                epochs = [x["producer_epoch"] for x, _ in old]
                if old and b["producer_epoch"] == epochs[-1]:
                    same = [(x, o) for x, o in old if x["producer_epoch"] == epochs[-1]][-5:]
                    hit = [o for x, o in same if x["base_sequence"] == b["base_sequence"]]
                    if hit:
                        out.append(("Duplicate", hit[-1]))
                        continue
                last = (mine(new) or old or [(None, None)])[-1][0]
                if last is None:
                    want = 0
                elif b["producer_epoch"] < last["producer_epoch"]:
                    return ["Rejected"] * len(batches)
                else:
                    want = last["base_sequence"] + last["record_count"] if b["producer_epoch"] == last["producer_epoch"] else 0
                if b["base_sequence"] != want:
                    return ["Rejected"] * len(batches)
            new.append((b, base))
            out.append(("Assigned", base))
        self.accepted += new
        return out


def script(seed):
    rng, out, nxt = random.Random(seed), [], {}
    for c in range(40):
        obj = []
        for i in range(rng.randint(1, 4)):
            part, pid = rng.randrange(4), rng.choice([-1, -1, 7, 8])
            b = batch(c, i, partition=part, count=rng.randint(1, 4))
            if pid >= 0:
                epoch, seq = nxt.get((pid, part), (0, 0))
                kind = rng.random()
                if kind < 0.1:
                    epoch, seq = epoch + 1, 0
                elif kind < 0.25:
                    seq = max(0, seq - rng.randint(1, 6))
                elif kind < 0.3:
                    seq += 3
                elif kind < 0.35:
                    epoch -= 1
                b |= {"producer_id": pid, "producer_epoch": epoch, "base_sequence": seq}
                if kind >= 0.25 or kind < 0.1:
                    nxt[pid, part] = (epoch, seq + b["record_count"])
            obj.append(b)
        out.append(obj)
    return out


@pytest.mark.parametrize("seed", range(250))
def test_against_model(seed):
    known = [("t", p) for p in range(4)]
    state, model = LogState(dict.fromkeys(known, 0)), Model(known)
    for obj in script(seed):
        got = state.commit(obj)
        want = model.commit(obj)
        assert [x["outcome"] if x["outcome"] == "Rejected" else (x["outcome"], x["base_offset"]) for x in got] == want
    assert {k: v for k, v in state.partitions.items()} == {k: model.hw(k) for k in known}


def test_poison_batch_rejects_object():
    s = LogState({("t", 0): 0, ("t", 1): 0})
    s.commit([batch(0, pid=5, epoch=0, seq=0, count=2)])
    got = s.commit([batch(1, 0, partition=1, count=3), batch(1, 1, pid=5, epoch=0, seq=5)])
    assert [g["outcome"] for g in got] == ["Rejected"] * 2 and (got[0]["error"], got[0]["expected"], got[0]["got"]) == ("OutOfOrderSequence", 2, 5)
    assert s.partitions == {("t", 0): 2, ("t", 1): 0}


def test_errors():
    s = LogState({("t", 0): 0}, txn_epochs={9: 2})
    assert s.commit([batch(0), batch(0, 1, partition=9)])[0]["error"] == "UnknownTopicOrPartition"
    s.commit([batch(0, pid=7, epoch=1, seq=0)])
    assert s.commit([batch(1, pid=7, epoch=0, seq=1)])[0]["error"] == "InvalidProducerEpoch"
    assert s.commit([batch(1, pid=9, epoch=1, seq=0)])[0]["error"] == "InvalidProducerEpoch"
    # the copy within one object is not yet committed: out of order, not a duplicate
    assert s.commit([batch(2, 0, pid=8, epoch=0, seq=0), batch(2, 1, pid=8, epoch=0, seq=0)])[0]["error"] == "OutOfOrderSequence"
    assert s.commit([]) == []


def test_duplicates_remember_five():
    s = LogState({("t", 0): 0})
    for i in range(7):
        s.commit([batch(i, pid=1, epoch=0, seq=i)])
    assert [s.commit([batch(9, pid=1, epoch=0, seq=i)])[0]["outcome"] for i in range(7)] == ["Rejected"] * 2 + ["Duplicate"] * 5


def test_spark_fold_and_fast_path(spark):
    from logweir.schemas import BATCHES, names

    for seed in (1, 2):
        objs = script(seed)
        df = spark.createDataFrame([tuple(b[c] for c in names(BATCHES)) for o in objs for b in o], BATCHES)
        got = {(r.commit_seq, r.batch_idx): (r.outcome, r.base_offset) for r in sequencer.commit_exact(df, spark.createDataFrame([("t", 4)], "topic string, partitions int")).collect()}
        s = LogState({("t", p): 0 for p in range(4)})
        want = {(b["commit_seq"], b["batch_idx"]): (r["outcome"], r["base_offset"]) for o in objs for b, r in zip(o, s.commit(o), strict=True)}
        assert got == want
    plain = [b | {"producer_id": -1} for o in script(3) for b in o]
    df = spark.createDataFrame([tuple(b[c] for c in names(BATCHES)) for b in plain], BATCHES)
    s = LogState({("t", p): 0 for p in range(4)})
    want = {}
    for c in range(40):
        o = [b for b in plain if b["commit_seq"] == c]
        want |= {(c, b["batch_idx"]): r["base_offset"] for b, r in zip(o, s.commit(o), strict=True)}
    assert {(r.commit_seq, r.batch_idx): r.base_offset for r in sequencer.commit_fast(df).collect()} == want


def as_frame(spark, batches):
    from logweir.schemas import BATCHES, names

    return spark.createDataFrame([tuple(b[c] for c in names(BATCHES)) for b in batches], BATCHES)


def test_plain_batches_are_no_duplicates(spark):
    """Three batches without a producer: nothing to recognise, fence or order."""
    d = as_frame(spark, [batch(i, count=2) for i in range(3)])
    assert [r.duplicate for r in sequencer.idempotent_dedup(d).collect()] == [False] * 3
    assert not any(r.fenced for r in sequencer.fencing(d).collect()) and sequencer.sequence_gap(d).count() == 0


def test_dedup_remembers_five(spark):
    rows = [batch(i, pid=1, epoch=0, seq=i) for i in range(7)] + [batch(10 + i, pid=1, epoch=0, seq=i) for i in range(7)]
    got = {r.commit_seq: r.duplicate for r in sequencer.idempotent_dedup(as_frame(spark, rows)).collect()}
    assert [got[10 + i] for i in range(7)] == [False, False, True, True, True, True, True] and not any(got[i] for i in range(7))


def test_domains(spark):
    rows = [batch(0, 0, pid=1, epoch=0, seq=0), batch(0, 1, pid=2, epoch=0, seq=0), batch(1, pid=2, epoch=0, seq=1), batch(2, pid=3, epoch=0, seq=0), batch(3), batch(4, partition=1, pid=1, epoch=0, seq=0)]
    got = {r.commit_seq: r.domain for r in sequencer.domains(as_frame(spark, rows)).collect()}
    assert got[0] == got[1] and len({got[0], got[2], got[4]}) == 3 and 3 not in got


def test_fences_of_open_transactions(spark):
    rows = [batch(0, pid=9, epoch=1, seq=0), batch(1, pid=9, epoch=2, seq=0), batch(2, pid=9, epoch=2, seq=1)]
    fences = spark.createDataFrame([(0, 9, 2), (1, 9, 2)], "commit_seq long, producer_id long, epoch int")
    topics = spark.createDataFrame([("t", 1)], "topic string, partitions int")
    got = {r.commit_seq: (r.outcome, r.error, r.base_offset) for r in sequencer.commit_exact(as_frame(spark, rows), topics, fences).collect()}
    assert got == {0: ("Rejected", "InvalidProducerEpoch", None), 1: ("Assigned", None, 0), 2: ("Assigned", None, 1)}


def test_catalogue_query_against_the_model(spark):
    """commit_object_exact over the orders of sf0.01: every row as a single fold in commit order gives it."""
    from logweir.plans import catalog

    directory = "/root/testdata/sf0.01"
    got = {(r.commit_seq, r.batch_idx): (r.outcome, r.base_offset, r.error, r.expected, r.got) for r in catalog.queries()["commit_object_exact"](spark, directory).collect()}
    objects = {}
    for r in catalog.idempotent_batches(spark.read.parquet(f"{directory}/orders.parquet")).collect():
        objects.setdefault(r.commit_seq, []).append(r.asDict())
    s = LogState({(t, p): 0 for t in {b["topic"] for o in objects.values() for b in o} for p in range(4)})
    want, kinds = {}, set()
    for c in sorted(objects):
        o = sorted(objects[c], key=lambda b: b["batch_idx"])
        for b, r in zip(o, s.commit(o), strict=True):
            want[c, b["batch_idx"]] = (r["outcome"], r["base_offset"], r["error"], r["expected"], r["got"])
            kinds.add((r["outcome"], r["error"]))
    assert got == want and len(kinds) == 4
