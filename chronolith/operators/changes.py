"""Applying and replaying change logs with precise outcomes.

Operations have key, op (I insert, U update, D delete) and an order.  Whether a
key is live before an operation depends on the last insert or delete before it
alone, so outcomes are a window, not a state machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EFFECTIVE = ("Inserted", "Updated", "Deleted")


def _classify(live: Column, ever: Column) -> Column:
    op = F.col("op")
    missing = F.when(ever, "KeyAlreadyDeleted").otherwise("KeyDoesNotExist")
    return (
        F.when(op == "I", F.when(live, "KeyAlreadyExists").otherwise("Inserted"))
        .when(op == "U", F.when(live, "Updated").otherwise(missing))
        .otherwise(F.when(live, "Deleted").otherwise(missing))
    )


def outcomes(ops: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, slice_by: Column | None = None) -> DataFrame:
    """Adds ``outcome``.  ``slice_by``, a number that grows with the order, cuts
    the operations of each key into slices: states at the start of the slices
    come from one row a slice, and no task sorts more than a slice of a hot key."""
    keys, order = keys or ["key"], order or ["ts_commit", "seq"]
    turn = F.when(F.col("op").isin("I", "D"), F.col("op"))
    part = keys if slice_by is None else [*keys, "_slice"]
    rows = ops if slice_by is None else ops.withColumn("_slice", slice_by)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prev, ever = F.last(turn, ignorenulls=True).over(w), F.max(F.col("op") == "I").over(w)
    if slice_by is None:
        return rows.withColumn("outcome", _classify(F.coalesce(prev == "I", F.lit(False)), F.coalesce(ever, F.lit(False))))
    at = F.struct(*order)
    ends = rows.groupBy(*part).agg(F.max_by(turn, F.when(turn.isNotNull(), at)).alias("_end"), F.max(F.col("op") == "I").alias("_any"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*part, F.last("_end", ignorenulls=True).over(earlier).alias("_start"), F.max("_any").over(earlier).alias("_was"))
    joined = rows.join(starts, part)
    live = F.coalesce(prev, F.col("_start")) == "I"
    was = F.coalesce(ever, F.lit(False)) | F.coalesce(F.col("_was"), F.lit(False))
    return joined.withColumn("outcome", _classify(F.coalesce(live, F.lit(False)), was)).drop("_slice", "_start", "_was")


def versions(
    done: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, payload: list[str] | None = None, slice_by: Column | None = None, timed: bool = False
) -> DataFrame:
    """The version history that effective operations leave: an insert or update
    opens a version, the key's next effective operation closes it.

    ``slice_by`` cuts keys into slices as for :func:`outcomes`: what closes the
    last version of a slice is the first operation of the next one.  ``timed``
    adds the commit times of both ends, ins_commit and del_commit."""
    keys, order, payload = keys or ["key"], order or ["ts_commit", "seq"], payload or []
    effective = done.where(F.col("outcome").isin(*EFFECTIVE))
    stamp = F.struct(F.col("worker").alias("w"), F.col("ts_start").alias("s"), "ts_commit") if timed else F.struct(F.col("worker").alias("w"), F.col("ts_start").alias("s"))
    if slice_by is None:
        closed = effective.withColumn("_next", F.lead(stamp).over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        part = [*keys, "_slice"]
        cut = effective.withColumn("_slice", slice_by)
        firsts = cut.groupBy(*part).agg(F.min_by(stamp, F.struct(*order)).alias("_first"))
        opens = firsts.select(*part, F.lead("_first").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_open"))
        inside = cut.withColumn("_inside", F.lead(stamp).over(Window.partitionBy(*part).orderBy(*order)))
        closed = inside.join(opens, part).withColumn("_next", F.coalesce("_inside", "_open"))
    ends = [F.col("ts_commit").alias("ins_commit"), F.col("_next.ts_commit").alias("del_commit")] if timed else []
    return closed.where("op <> 'D'").select(
        *keys,
        F.col("worker").alias("insert_worker"),
        F.col("ts_start").alias("insert_ts"),
        F.lit(False).alias("insert_invalid"),
        F.col("_next.w").alias("delete_worker"),
        F.col("_next.s").alias("delete_ts"),
        *ends,
        *payload,
    )


def final_state(done: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, payload: list[str] | None = None) -> DataFrame:
    """Live keys with the payload of their last effective write: an aggregate
    with partial results, as no row but each key's last matters."""
    keys, order, payload = keys or ["key"], order or ["ts_commit", "seq"], payload or []
    last = done.where(F.col("outcome").isin(*EFFECTIVE)).groupBy(*keys).agg(F.max_by(F.struct("op", *payload), F.struct(*order)).alias("v"))
    return last.where("v.op <> 'D'").select(*keys, *(F.col(f"v.{c}").alias(c) for c in payload))


def committed(writes: DataFrame, commits: DataFrame) -> DataFrame:
    """Commit-gated log: writes of (worker, ts_start) with a commit, and its time."""
    return writes.join(commits.select("worker", "ts_start", "ts_commit"), ["worker", "ts_start"])


def overlay(base: DataFrame, own: DataFrame, key: str = "key") -> DataFrame:
    """What a transaction reads: its own live keys over the base, without the
    keys it deleted.  ``own`` has the base's columns and ``deleted``."""
    kept = base.join(own.select(key), key, "left_anti").select(*base.columns)
    return kept.unionByName(own.where("NOT deleted").select(*base.columns))


def own_writes(statements: DataFrame, txn: str = "txn", key: str = "key", order: str = "seq") -> DataFrame:
    """A transaction's last write of each key: (txn, key, deleted, value)."""
    last = statements.groupBy(txn, key).agg(F.max_by(F.struct("op", "value"), order).alias("v"))
    return last.select(txn, key, (F.col("v.op") == "D").alias("deleted"), F.col("v.value").alias("value"))


def own_outcomes(statements: DataFrame, base: DataFrame) -> DataFrame:
    """Adds ``outcome`` to the statements (txn, seq, key, op) of transactions that
    see ``base`` (key) under their own writes: a key that the table holds counts
    as inserted before the first statement."""
    asked = statements.select("txn", "key").distinct().join(base, "key", "left_semi")
    before = asked.select("txn", F.lit(-1).cast("long").alias("seq"), "key", F.lit("I").alias("op"))
    rows = statements.select("txn", "seq", "key", "op").unionByName(before)
    return outcomes(rows, keys=["txn", "key"], order=["seq"]).where("seq >= 0")


def aborted(history: DataFrame, stamps: DataFrame) -> DataFrame:
    """The history after the transactions of ``stamps`` (worker, ts_start) are
    rolled back: their inserts invalid, their deletions undone."""
    bad = stamps.select("worker", "ts_start").distinct()
    i = bad.select(F.col("worker").alias("insert_worker"), F.col("ts_start").alias("insert_ts"), F.lit(True).alias("_i"))
    d = bad.select(F.col("worker").alias("delete_worker"), F.col("ts_start").alias("delete_ts"), F.lit(True).alias("_d"))
    rows = history.join(i, ["insert_worker", "insert_ts"], "left").join(d, ["delete_worker", "delete_ts"], "left")
    undone = F.col("_d").isNotNull()
    new = {
        "insert_invalid": F.col("insert_invalid") | F.col("_i").isNotNull(),
        "delete_worker": F.when(~undone, F.col("delete_worker")),
        "delete_ts": F.when(~undone, F.col("delete_ts")),
    }
    return rows.withColumns(new).select(*history.columns)


def upsert(base: DataFrame, arrivals: DataFrame, key: str, order: str) -> DataFrame:
    """The table after arrivals: the last arrival of a key wins, whatever its
    event time.  Arrivals have the base's columns and ``order``."""
    rest = [c for c in base.columns if c != key]
    last = arrivals.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_new"))
    both = base.join(last, key, "full")
    pick = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in rest]
    return both.select(key, *pick)


def update_with(base: DataFrame, requests: DataFrame, key: str, combine: list[Column], derive: dict[str, Column]) -> DataFrame:
    """Rows derived from the latest ones: (base columns, outcome) of every asked key.

    ``combine`` aggregates the requests of a key, in any order; ``derive`` gives new
    values over the base's columns and what was combined.  A key that is not there
    is not made: its outcome is KeyDoesNotExist and its columns are null."""
    asked = requests.groupBy(key).agg(*combine)
    held = base.withColumn("_held", F.lit(True))
    found = asked.join(held, key, "left")
    new = {c: F.when(F.col("_held"), derive.get(c, F.col(c))) for c in base.columns if c != key}
    outcome = F.when(F.col("_held"), "Updated").otherwise("KeyDoesNotExist")
    return found.select(key, *(x.alias(c) for c, x in new.items()), outcome.alias("outcome"))


def read_modify_write(base: DataFrame, writes: DataFrame, key: str, order: str, fields: int, width: int, row: str = "row") -> DataFrame:
    """Rows after writes (key, order, field, patch) that each read a row and put
    one field of it back, or the whole row where ``field`` is null.

    In order of the key, a write of the whole row covers all before it, and a later
    write of a field lies over it; so each field's last value is an aggregate.
    Writes of keys that are not there change nothing."""
    at = F.col(order)
    whole = F.max_by("patch", F.when(F.col("field").isNull(), at)).alias("_whole")
    seen = F.max(F.when(F.col("field").isNull(), at)).alias("_seen")
    each = [x for f in range(fields) for x in (F.max_by("patch", F.when(F.col("field") == f, at)).alias(f"_p{f}"), F.max(F.when(F.col("field") == f, at)).alias(f"_o{f}"))]
    last = writes.groupBy(key).agg(whole, seen, *each, F.count("*").alias("writes"))
    out = F.coalesce("_whole", row)
    for f in range(fields):
        newer = F.col(f"_o{f}").isNotNull() & (F.col("_seen").isNull() | (F.col(f"_o{f}") > F.col("_seen")))
        out = F.when(newer, F.overlay(out, F.col(f"_p{f}"), f * width + 1, width)).otherwise(out)
    return base.join(last, key).select(key, out.alias(row), "writes")


def hot_upsert(arrivals: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, payload): rows after arrivals, which make a key or replace its
    row, and updates, which only replace the row of a key that has arrived."""
    rest = [c for c in arrivals.columns if c not in (key, order)]
    both = arrivals.withColumn("_made", F.col(order)).unionByName(updates.withColumn("_made", F.lit(None).cast("long")))
    first = both.groupBy(key).agg(F.min("_made").alias("_first")).where("_first IS NOT NULL")
    known = both.join(first, key).where(F.col(order) >= F.col("_first"))
    last = known.groupBy(key).agg(F.max_by(F.struct(order, *rest), order).alias("v"))
    return last.select(key, f"v.{order}", *(f"v.{c}" for c in rest))


def collapse(history: DataFrame, snapshots: list[int]) -> DataFrame:
    """Versions that some snapshot (or the present) can see: a version that was
    both committed and replaced between two snapshots is left out."""
    seen = F.col("del_commit").isNull()
    for t in snapshots:
        seen = seen | ((F.col("ins_commit") < t) & (F.col("del_commit") >= t))
    return history.where(seen)
