"""How the driver's tables stand for the engine's relations, in Spark and in SQL.

Order lines are ``lineitem``; a line with status O is not delivered.  The
change log is ``events``: a key and a worker for each user, one transaction per
event, of which errors are rolled back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import changes

LINES_SQL = """
lines AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS ol_number, CAST(l_quantity AS bigint) AS qty,
                 CAST(floor(l_extendedprice * 100 + 0.5) AS bigint) AS cents, l_discount, l_tax,
                 CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_shipdate END AS delivered FROM lineitem)"""


def cents(column: str):
    """An amount in whole hundredths: sums of longs are exact in any order, and
    stay in primitive code."""
    return F.floor(F.col(column) * 100 + 0.5).cast("long")


def lines(t) -> DataFrame:
    return t("lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.col("l_linenumber").alias("ol_number"),
        F.col("l_quantity").cast("long").alias("qty"),
        cents("l_extendedprice").alias("cents"),
        "l_discount",
        "l_tax",
        F.when(F.col("l_linestatus") != "O", F.col("l_shipdate")).alias("delivered"),
        "l_shipdate",
        "l_linestatus",
    )


def delivered(test: Callable[[Column], Column]) -> Column:
    """A test of the delivery date, as one of stored columns: it reaches the
    file scan, where a test of the derived column could not."""
    return (F.col("l_linestatus") != "O") & test(F.col("l_shipdate"))


#: Workers of the change log, and how long a transaction takes if nothing of its worker follows.
WORKERS, LAG = 64, 55

OPS_SQL = f"""
ops AS (SELECT event_id AS seq, user_id AS key, user_id % {WORKERS} AS worker, 10 * event_id AS ts_start,
               CASE event_type WHEN 'signup' THEN 'I' WHEN 'purchase' THEN 'D' WHEN 'error' THEN 'X' ELSE 'U' END AS op, value FROM events),
txn AS (SELECT *, least(ts_start + {LAG}, coalesce(lead(ts_start) OVER (PARTITION BY worker ORDER BY ts_start) - 1, ts_start + {LAG})) AS ts_end FROM ops),
commits AS (SELECT worker, ts_start, ts_end AS ts_commit FROM txn WHERE op <> 'X')"""

HISTORY_SQL = (
    OPS_SQL
    + """,
w AS (SELECT *, ts_end AS ts_commit,
             last_value(CASE WHEN op IN ('I', 'D') THEN op END IGNORE NULLS) OVER b AS prev, max(op = 'I') OVER b AS ever
      FROM txn WHERE op <> 'X' WINDOW b AS (PARTITION BY key ORDER BY ts_end, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
done AS (SELECT seq, key, worker, ts_start, ts_commit, op, value,
                CASE op WHEN 'I' THEN CASE WHEN prev = 'I' THEN 'KeyAlreadyExists' ELSE 'Inserted' END
                        WHEN 'U' THEN CASE WHEN prev = 'I' THEN 'Updated' WHEN ever THEN 'KeyAlreadyDeleted' ELSE 'KeyDoesNotExist' END
                        ELSE CASE WHEN prev = 'I' THEN 'Deleted' WHEN ever THEN 'KeyAlreadyDeleted' ELSE 'KeyDoesNotExist' END END AS outcome FROM w),
eff AS (SELECT *, lead(worker) OVER k AS delete_worker, lead(ts_start) OVER k AS delete_ts, lead(ts_commit) OVER k AS del_commit
        FROM done WHERE outcome IN ('Inserted', 'Updated', 'Deleted') WINDOW k AS (PARTITION BY key ORDER BY ts_commit, seq)),
history AS (SELECT key, worker AS insert_worker, ts_start AS insert_ts, false AS insert_invalid, delete_worker, delete_ts, ts_commit AS ins_commit, del_commit, value
            FROM eff WHERE op <> 'D'
            UNION ALL SELECT key, worker, ts_start, true, NULL, NULL, NULL, NULL, value FROM ops WHERE op = 'X')"""
)


def ops(t) -> DataFrame:
    e = F.col("event_type")
    op = F.when(e == "signup", "I").when(e == "purchase", "D").when(e == "error", "X").otherwise("U")
    return t("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), (F.col("user_id") % WORKERS).alias("worker"), (10 * F.col("event_id")).alias("ts_start"), op.alias("op"), "value")


#: Ticks of a slice of the clock: hot workers and hot keys are worked on by slices.
SLICE = 1 << 16


def transactions(t) -> DataFrame:
    """Operations with the time at which their transaction ended: a worker runs
    one transaction at a time, and one that nothing follows ends after LAG.

    Only what starts within LAG matters to an end, so time is cut into slices;
    rows at the start of a slice are shown to the slice before as well."""
    start, cut = F.col("ts_start"), F.floor(F.col("ts_start") / SLICE)
    shown = F.array(cut, F.when(start % SLICE <= LAG, cut - 1))
    rows = ops(t).withColumn("_slice", F.explode(F.filter(shown, lambda s: s.isNotNull())))
    nxt = F.lead("ts_start").over(Window.partitionBy("worker", "_slice").orderBy("ts_start"))
    end = F.least(start + LAG, F.coalesce(nxt - 1, start + LAG))
    return rows.withColumn("ts_end", end).where(F.col("_slice") == cut).drop("_slice")


def commits_of(txn: DataFrame) -> DataFrame:
    return txn.where("op <> 'X'").select("worker", "ts_start", F.col("ts_end").alias("ts_commit"))


def outcomes(t) -> DataFrame:
    done = transactions(t).where("op <> 'X'").withColumnRenamed("ts_end", "ts_commit")
    return changes.outcomes(done, slice_by=F.floor(F.col("ts_commit") / SLICE))


def build_history(t) -> DataFrame:
    """Versions of all effective operations, and aborted inserts as invalid ones."""
    valid = changes.versions(outcomes(t), payload=["value"], slice_by=F.floor(F.col("ts_commit") / SLICE), timed=True)
    none = F.lit(None).cast("long")
    bad = ops(t).where("op = 'X'").select(
        "key", F.col("worker").alias("insert_worker"), F.col("ts_start").alias("insert_ts"), F.lit(True).alias("insert_invalid"),
        none.alias("delete_worker"), none.alias("delete_ts"), none.alias("ins_commit"), none.alias("del_commit"), "value",
    )
    return valid.unionByName(bad).sortWithinPartitions("key")


# A history and its commit log are stored tables, as those of any engine that keeps
# versions: written once, sorted by key within a file, so that key filters prune.


def timed_history(t) -> DataFrame:
    """The history with commit times of insertion and deletion."""
    return t.stored("history", "events", lambda: build_history(t))


def history(t) -> DataFrame:
    return timed_history(t).drop("ins_commit", "del_commit")


def commits(t) -> DataFrame:
    return t.stored("commits", "events", lambda: commits_of(transactions(t)))


def span(t) -> int:
    """Transactions on the clock: one more than the largest number, or 0."""
    return t.once("span", "events", lambda: (t("events").agg(F.max("event_id")).first()[0] or -1) + 1)


def tenths(t, k: float) -> int:
    """A time within the log, after k tenths of it."""
    return int(span(t) * k) + 3


#: The same in SQL.
TENTHS_SQL = "(SELECT floor((max(event_id) + 1) * {k})::bigint + 3 FROM events)"
