"""Tables with a shared clock: outcomes over batches, time travel, what-if runs."""

from pyspark.sql import functions as F

from chronolith.operators.database import Database, Step, what_if


def ops(spark, rows):
    return spark.createDataFrame(rows, "seq long, key long, op string, value long")


def test_batches_see_earlier_batches(spark):
    db = Database(spark)
    assert (db.create("a"), db.create("b"), db.create("a")) == (0, 1, 0)
    first = {r.seq: r.outcome for r in db.apply("a", ops(spark, [(0, 1, "I", 10), (1, 2, "I", 20), (2, 2, "D", None), (3, 3, "U", 1)])).collect()}
    assert first == {0: "Inserted", 1: "Inserted", 2: "Deleted", 3: "KeyDoesNotExist"}
    then = db.now
    second = {r.seq: r.outcome for r in db.apply("a", ops(spark, [(0, 1, "I", 0), (1, 1, "U", 11), (2, 2, "U", 0), (3, 2, "I", 22), (4, 1, "D", None), (5, 1, "D", None)])).collect()}
    assert second == {0: "KeyAlreadyExists", 1: "Updated", 2: "KeyAlreadyDeleted", 3: "Inserted", 4: "Deleted", 5: "KeyAlreadyDeleted"}
    assert sorted(map(tuple, db.snapshot("a").collect())) == [(2, 22)]
    assert sorted(map(tuple, db.snapshot("a", then).collect())) == [(1, 10)]
    assert db.snapshot("b").count() == 0
    assert db.apply("b", ops(spark, []).where("false")).count() == 0


def test_single_operations(spark):
    db = Database(spark)
    db.create("t")
    assert [db.dispatch("t", "insert", 5, value=1), db.dispatch("t", "insert", 5, value=2), db.dispatch("t", "update", 5, value=3), db.dispatch("t", "delete", 6)] == ["Inserted", "KeyAlreadyExists", "Updated", "KeyDoesNotExist"]
    assert db.dispatch("t", "point", 5).first().value == 3 and db.dispatch("t", "range", 0, 4).count() == 0


def test_what_if(spark):
    db = Database(spark)
    db.create("t")
    db.apply("t", ops(spark, [(0, 1, "I", 10), (1, 2, "I", 20)]))
    old = db.now
    db.apply("t", ops(spark, [(0, 1, "U", 11)]))
    run = lambda *steps, **k: what_if(db, list(steps), **k)
    got, aborted = run(Step("read", "t", 1), Step("update", "t", 1, values={"value": 99}), Step("delete", "t", 2), Step("insert", "t", 3, values={"value": 30}), Step("scan", "t", 0, 9))
    assert not aborted and [s for s, _ in got] == ["found", "updated", "deleted", "inserted", "matched"]
    assert [(r.key, r.value) for r in got[-1][1]] == [(1, 99), (3, 30)]
    assert sorted(map(tuple, db.snapshot("t").collect())) == [(1, 11), (2, 20)]
    assert run(Step("read", "t", 1), at=old)[0][0][1][0].value == 10
    assert run(Step("insert", "t", 1), Step("read", "t", 1))[1] and run(Step("update", "t", 9))[0] == [("missing", [])]
    assert run(Step("read", "t", 1, where=F.col("value") > 50))[0][0][0] == "filtered"
    for mode in ("rc", "ru"):
        assert run(Step("read", "t", 1), mode=mode)[0][0][1][0].value == 11
