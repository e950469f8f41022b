"""Visibility, change application, conflicts and retention on worked examples."""

import random

from pyspark.sql import functions as F

from chronolith.operators import changes, conflicts, retention
from chronolith.operators import history as hist

H = "key long, insert_worker long, insert_ts long, insert_invalid boolean, delete_worker long, delete_ts long, value long"
C = "worker long, ts_start long, ts_commit long"


def keys(df, *names):
    return sorted(tuple(r[n] for n in names or ("key",)) for r in df.collect())


def test_visibility_worked_example(spark):
    h = spark.createDataFrame([(1, 1, 1, False, None, None, 1), (2, 1, 3, False, None, None, 2), (3, 2, 5, False, None, None, 3)], H)
    c = spark.createDataFrame([(1, 1, 2), (1, 3, 4)], C)
    assert keys(hist.snapshot(h, c, 6)) == [(1,), (2,)]
    assert {r.worker: r.lcb for r in hist.lcb(c, 6).collect()} == {1: 4}
    assert {r.worker: r.lcb for r in hist.progress(c.union(spark.createDataFrame([(2, 5, 9)], C)), 6).collect()} == {1: 4, 2: 0}


def test_late_commit(spark):
    h = spark.createDataFrame([(1, 1, 1, False, None, None, 1)], H)
    c = spark.createDataFrame([(1, 1, 3)], C)
    assert keys(hist.snapshot(h, c, 2)) == [] and keys(hist.snapshot(h, c, 3)) == [] and keys(hist.snapshot(h, c, 4)) == [(1,)]


def test_invalid_stamps_stay_hidden_after_later_commits(spark):
    h = spark.createDataFrame([(1, 1, 1, True, None, None, 1), (2, 1, 5, False, None, None, 1)], H)
    c = spark.createDataFrame([(1, 5, 6)], C)
    assert keys(hist.snapshot(h, c, 9)) == [(2,)]
    assert keys(hist.phantoms(h, 9)) == [(1,)]


def test_deletion_seen_only_after_its_commit(spark):
    h = spark.createDataFrame([(1, 1, 1, False, 2, 5, 1)], H)
    c = spark.createDataFrame([(1, 1, 2), (2, 5, 8)], C)
    assert [keys(hist.snapshot(h, c, t)) for t in (6, 8, 9)] == [[(1,)], [(1,)], []]


def fold(ops):
    live, ever, out = {}, set(), {}
    for seq, key, op in ops:
        on = live.get(key, False)
        gone = "KeyAlreadyDeleted" if key in ever else "KeyDoesNotExist"
        out[seq] = ("KeyAlreadyExists" if on else "Inserted") if op == "I" else ("Updated" if on else gone) if op == "U" else ("Deleted" if on else gone)
        if op == "I":
            live[key] = True
            ever.add(key)
        elif op == "D":
            live[key] = False
    return out, {k for k, v in live.items() if v}


def test_outcomes_equal_a_fold(spark):
    r = random.Random(5)
    ops = [(i, r.choice([0, 0, 0, 1, 2, 3, 4, 5]), r.choice("IUDU")) for i in range(600)]
    want, alive = fold(ops)
    df = spark.createDataFrame([(s, k, o, 1, s, s) for s, k, o in ops], "seq long, key long, op string, worker long, ts_start long, ts_commit long")
    for slices in (None, F.floor(F.col("seq") / 7), F.floor(F.col("seq") / 100)):
        done = changes.outcomes(df, slice_by=slices)
        assert {x.seq: x.outcome for x in done.collect()} == want
    assert {x.key for x in changes.final_state(done, payload=["seq"]).collect()} == alive
    v = changes.versions(done)
    assert v.where("delete_ts IS NULL").count() == len(alive)


def test_crud_persistence(spark):
    ops = [(i, i, "I") for i in range(100)] + [(100 + i, i, "U") for i in range(0, 100, 2)] + [(200 + i, i, "D") for i in range(0, 100, 4)]
    df = spark.createDataFrame([(s, k, o, 1, s, s, 10 * k if o == "I" else 1000 * k) for s, k, o in ops], "seq long, key long, op string, worker long, ts_start long, ts_commit long, value long")
    left = {r.key: r.value for r in changes.final_state(changes.outcomes(df), payload=["value"]).collect()}
    assert len(left) == 75 and left[2] == 2000 and left[3] == 30 and 4 not in left


def test_commit_gated_log(spark):
    w = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (2, 5, 3)], "worker long, ts_start long, seq long")
    assert keys(changes.committed(w, spark.createDataFrame([(1, 1, 2), (2, 5, 6)], C)), "seq") == [(1,), (3,)]


def test_rollback_restores(spark):
    h = spark.createDataFrame([(1, 1, 1, False, 2, 5, 1), (1, 2, 5, False, None, None, 2)], H)
    back = changes.aborted(h, spark.createDataFrame([(2, 5)], "worker long, ts_start long"))
    assert keys(back.where("NOT insert_invalid AND delete_ts IS NULL"), "key", "value") == [(1, 1)]


def test_own_writes_over_base(spark):
    base = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "key long, value long")
    own = changes.own_writes(spark.createDataFrame([(1, 2, "U", 21, 1), (1, 3, "D", None, 2), (1, 4, "I", 40, 3), (1, 5, "I", 50, 4), (1, 5, "D", None, 5)], "txn long, key long, op string, value long, seq long"))
    assert keys(changes.overlay(base, own.select("key", "value", "deleted")), "key", "value") == [(1, 10), (2, 21), (4, 40)]


def test_first_writer_wins(spark):
    w = "key long, worker long, seq long, ts_start long, read_ts long, ts_commit long"
    rows = [(1, 9, 1, 0, 0, 1), (1, 2, 2, 3, 3, 5), (1, 1, 3, 2, 2, 7), (1, 3, 4, 8, 8, 9)]
    got = {r.seq: r.conflict for r in conflicts.first_writer(spark.createDataFrame(rows, w)).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}


def test_cascading_rollbacks(spark):
    w = "key long, worker long, seq long, ts_start long, read_ts long, ts_commit long"
    # 2 loses to 1; 3 began before 2 would have committed but after 1 did, so it wins only if 2 is gone.
    rows = [(1, 1, 1, 0, 0, 10), (1, 2, 2, 5, 5, 20), (1, 3, 3, 15, 15, 30)]
    df = spark.createDataFrame(rows, w)
    assert {r.seq: r.conflict for r in conflicts.first_writer(df).collect()} == {1: False, 2: True, 3: True}
    assert {r.seq: r.conflict for r in conflicts.serial_winners(df).collect()} == {1: False, 2: True, 3: False}


def test_read_committed(spark):
    v = spark.createDataFrame([(1, 5, 10), (1, 9, 20)], "key long, ts_commit long, value long")
    s = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 1, 9), (4, 1, 10), (5, 2, 10)], "id long, key long, ts long")
    assert {r.id: r.value for r in conflicts.read_committed(s, v).collect()} == {1: None, 2: 10, 3: 10, 4: 20, 5: None}


def test_streaming_upsert_last_arrival_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 3)], "k long, v string, seq long")
    assert sorted(map(tuple, changes.upsert(base, new, "k", "seq").collect()), key=str) == [(1, "a"), (2, "y"), (3, None)]


def test_counts_at_equal_snapshots(spark, sf):
    from chronolith.plans import base
    from chronolith.plans.registry import Tables

    t = Tables(spark, sf)
    h, c = base.history(t).cache(), base.commits(t).cache()
    times = [1, 1003, 5003, 5004, 9999]
    got = {r.at: r.n for r in hist.counts_at(hist.with_commit_times(h, c), times).collect()}
    assert got == {x: hist.snapshot(h, c, x).count() for x in times}


def test_retention_keeps_what_the_oldest_reader_sees(spark):
    timed = spark.createDataFrame(
        [(1, 1, False, 5, 2, 6, 1), (1, 5, False, None, 6, None, 2), (2, 1, False, 3, 2, 4, 3), (3, 1, False, 9, 2, None, 4), (4, 1, True, None, None, None, 5)],
        "key long, insert_ts long, insert_invalid boolean, delete_ts long, ins_commit long, del_commit long, value long",
    )
    assert keys(retention.retained(timed, 5), "value") == [(1,), (2,), (4,)]


def test_commit_log_pruning(spark):
    c = spark.createDataFrame([(1, 0, t) for t in (2, 4, 6, 8)] + [(2, 0, 1), (2, 0, 3)], C)
    kept = retention.pruned_commits(c, [5], 7)
    assert keys(kept, "worker", "ts_commit") == [(1, 4), (1, 6), (1, 8), (2, 3)]


def test_asof_strictness(spark):
    left = spark.createDataFrame([(1, 5)], "g long, t long")
    right = spark.createDataFrame([(1, 5, "x"), (1, 4, "y")], "g long, r long, v string")
    assert hist.asof(left, right, ["g"], "t", "r", ["v"]).first().v == "x"
    assert hist.asof(left, right, ["g"], "t", "r", ["v"], strict=True).first().v == "y"


def test_asof_in_slices_equals_brute_force(spark):
    r = random.Random(9)
    left = [(r.choice([1, 1, 1, 2, None]), i, r.randrange(200)) for i in range(300)]
    right = [(r.choice([1, 1, 2]), t, t * 10 if t % 4 else None) for t in r.sample(range(200), 40)]
    ldf, rdf = spark.createDataFrame(left, "g long, i long, t long"), spark.createDataFrame(right, "g long, rt long, v long")
    for strict in (False, True):
        def last(g, t):
            found = [(rt, v) for k, rt, v in right if k == g and (rt < t if strict else rt <= t)]
            return max(found)[1] if found else None

        want = {i: last(g, t) for g, i, t in left}
        for width in (None, 1, 7, 1000):
            assert {x.i: x.v for x in hist.asof(ldf, rdf, ["g"], "t", "rt", ["v"], strict, width).collect()} == want
