"""Version histories, commit logs and snapshots.

A history has a row per physical version: key, insert_worker, insert_ts,
insert_invalid, delete_worker, delete_ts (null while not deleted) and payload
columns.  A commit log has worker, ts_start, ts_commit.  Everything is joins on
small per-worker tables and filters, so key ranges reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lcb(commits: DataFrame, at: int) -> DataFrame:
    """(worker, lcb): each worker's last commit strictly before ``at``."""
    return commits.where(F.col("ts_commit") < at).groupBy("worker").agg(F.max("ts_commit").alias("lcb"))


def progress(commits: DataFrame, at: int) -> DataFrame:
    """(worker, lcb) for every worker, 0 where nothing was committed before ``at``."""
    last = F.max(F.when(F.col("ts_commit") < at, F.col("ts_commit")))
    return commits.groupBy("worker").agg(F.coalesce(last, F.lit(0)).cast("long").alias("lcb"))


def snapshot(history: DataFrame, commits: DataFrame, at: int) -> DataFrame:
    """The versions that a reader at ``at`` sees: inserted visibly, not deleted
    visibly.  A stamp is visible if it is valid and its worker's last commit
    before ``at`` lies after its start."""
    seen = lcb(commits, at)
    ins = seen.select(F.col("worker").alias("_iw"), F.col("lcb").alias("_il"))
    dele = seen.select(F.col("worker").alias("_dw"), F.col("lcb").alias("_dl"))
    rows = history.where("NOT insert_invalid").where(F.col("insert_ts") < at)
    rows = rows.join(ins, (F.col("insert_worker") == F.col("_iw")) & (F.col("_il") > F.col("insert_ts")))
    rows = rows.join(dele, F.col("delete_worker") == F.col("_dw"), "left")
    gone = F.coalesce(F.col("_dl") > F.col("delete_ts"), F.lit(False))
    return rows.where(~gone).select(*history.columns)


def with_commit_times(history: DataFrame, commits: DataFrame) -> DataFrame:
    """The history with ins_commit and del_commit: half-open validity in commit
    time, from which a snapshot at any time is two comparisons."""
    c = commits.select(F.col("worker").alias("_w"), F.col("ts_start").alias("_s"), "ts_commit")
    ins = c.withColumnRenamed("ts_commit", "ins_commit")
    dele = c.withColumnRenamed("ts_commit", "del_commit")
    rows = history.join(ins, (F.col("insert_worker") == F.col("_w")) & (F.col("insert_ts") == F.col("_s")), "left").drop("_w", "_s")
    return rows.join(dele, (F.col("delete_worker") == F.col("_w")) & (F.col("delete_ts") == F.col("_s")), "left").drop("_w", "_s")


def visible_at(at: Column | int) -> Column:
    """Over a history with commit times: what a reader at ``at`` sees."""
    t = at if isinstance(at, Column) else F.lit(at)
    return ~F.col("insert_invalid") & (F.col("ins_commit") < t) & (F.col("del_commit").isNull() | (F.col("del_commit") >= t))


def counts_at(timed: DataFrame, times: list[int]) -> DataFrame:
    """(at, n): visible rows at each of many times, in one pass over the history.

    A version adds one once it is committed and takes one away once its deletion
    is.  Deltas are summed by the interval between asked times in which they
    fall, so only as many rows as times are ever sorted."""
    at = sorted(set(times))
    edges = F.array(*(F.lit(t).cast("long") for t in at))
    live = timed.where(~F.col("insert_invalid") & F.col("ins_commit").isNotNull())
    changes = F.array(F.struct(F.col("ins_commit").alias("c"), F.lit(1).alias("d")), F.struct(F.col("del_commit").alias("c"), F.lit(-1).alias("d")))
    deltas = live.select(F.explode(changes).alias("x")).where("x.c IS NOT NULL")
    # The first asked time after the change: the reader at t sees what was committed before t.
    sums = deltas.groupBy(F.size(F.filter(edges, lambda t: t <= F.col("x.c"))).alias("i")).agg(F.sum("x.d").alias("d"))
    asked = live.sparkSession.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, at long")
    order = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return asked.join(sums, "i", "left").select("at", F.coalesce(F.sum("d").over(order), F.lit(0)).cast("long").alias("n"))


def phantoms(history: DataFrame, at: int) -> DataFrame:
    """Aborted inserts up to ``at``."""
    return history.where(F.col("insert_invalid") & (F.col("insert_ts") <= at))


def physical(history: DataFrame) -> DataFrame:
    """Read uncommitted: the newest version of each key, seen or not."""
    rest = [c for c in history.columns if c != "key"]
    newest = history.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("insert_ts", "insert_worker")).alias("v"))
    return newest.select("key", *(F.col(f"v.{c}").alias(c) for c in rest))


def activity(history: DataFrame, commits: DataFrame) -> DataFrame:
    """(worker, commits, writes, deletes): distinct stamps by worker."""
    c = commits.groupBy("worker").agg(F.count("*").alias("commits"))
    w = history.groupBy(F.col("insert_worker").alias("worker")).agg(F.count_distinct("key", "insert_ts").alias("writes"))
    d = history.where("delete_ts IS NOT NULL").groupBy(F.col("delete_worker").alias("worker")).agg(F.count_distinct("key", "delete_ts").alias("deletes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return c.join(w, "worker", "full").join(d, "worker", "full").select(F.col("worker").cast("long").alias("worker"), *map(zero, ("commits", "writes", "deletes")))


def clock(history: DataFrame) -> DataFrame:
    """(last_ts, next_ts, max_worker) from the stamps."""
    last = F.greatest(F.max("insert_ts"), F.max("delete_ts"))
    return history.agg(last.alias("last_ts"), (last + 1).alias("next_ts"), F.greatest(F.max("insert_worker"), F.max("delete_worker")).alias("max_worker"))


def staleness(now: Column, at: Column) -> Column:
    return F.greatest(now - at, F.lit(0).cast("long"))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, value: list[str], strict: bool = False, width: int | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its group at or
    before its time (strictly before if ``strict``).

    Both sides are merged into one stream per group and the last right value is
    carried forward: one shuffle on the group's key and no range join.  With a
    ``width``, groups are cut into slices of that many time units, and what a
    slice opens with comes from one row for each slice, so that no task sorts
    more than a slice of a hot group."""
    packed = F.struct(*(F.col(c) for c in value))
    rest = [c for c in left.columns if c not in by]
    l_rows = left.select(*by, F.col(left_ts).alias("_ts"), F.struct(*rest).alias("_l"))
    r_rows = right.select(*by, F.col(right_ts).alias("_ts"), packed.alias("_r"))
    if width is None:
        found = _carry(l_rows, r_rows, by, strict)
    else:
        cut = F.floor(F.col("_ts") / width).alias("_slice")
        l_rows, r_rows = l_rows.select("*", cut), r_rows.select("*", cut)
        inside = _carry(l_rows, r_rows, [*by, "_slice"], strict)
        ends = r_rows.groupBy(*by, "_slice").agg(F.max_by("_r", "_ts").alias("_r"))
        asked = l_rows.select(*by, "_slice").distinct()
        opens = _carry(asked.select(*by, F.col("_slice").alias("_ts"), F.struct("_slice").alias("_l")), ends.select(*by, F.col("_slice").alias("_ts"), "_r"), by, True)
        opens = opens.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(by)), F.col("_l._slice").alias("_os"), F.col("_last").alias("_open"))
        same = F.col("_slice") == F.col("_os")
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_o{i}"))
        found = inside.join(opens, same, "left").withColumn("_last", F.coalesce("_last", "_open"))
    return found.select(*by, *(F.col(f"_l.{c}").alias(c) for c in rest), *(F.col(f"_last.{c}").alias(c) for c in value))


def _carry(left: DataFrame, right: DataFrame, by: list[str], strict: bool) -> DataFrame:
    """Left rows (by, _ts, _l) with ``_last``, the _r of the last right row (by, _ts, _r)."""
    merged = left.withColumn("_kind", F.lit(0 if strict else 1)).unionByName(right.withColumn("_kind", F.lit(1 if strict else 0)), allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("_ts", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return merged.withColumn("_last", F.last("_r", ignorenulls=True).over(order)).where("_l IS NOT NULL").select(*by, "_l", "_last")
