"""Snapshots and inspection of version histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as hist
from .base import HISTORY_SQL, OPS_SQL, TENTHS_SQL, commits, history, span, tenths, timed_history
from .registry import register

T_MID = TENTHS_SQL.format(k=5)
TIMES = (1, 3, 5, 7, 9)

_LCB = "lcb AS (SELECT worker, max(ts_commit) AS lcb FROM commits WHERE ts_commit < {at} GROUP BY worker)"
_SNAP = """SELECT h.key, h.insert_ts, h.value FROM history h JOIN lcb i ON h.insert_worker = i.worker AND i.lcb > h.insert_ts
LEFT JOIN lcb d ON h.delete_worker = d.worker WHERE NOT h.insert_invalid AND NOT coalesce(d.lcb > h.delete_ts, false)"""


@register("version_history", "TX-01 WR-06", "WITH" + HISTORY_SQL + " SELECT key, insert_worker, insert_ts, insert_invalid, delete_worker, delete_ts, value FROM history")
def version_history(t):
    return history(t)


def _at(name: str, k: int, ids: str):
    @register(name, ids, "WITH" + HISTORY_SQL + ", " + _LCB.format(at=TENTHS_SQL.format(k=k)) + " " + _SNAP)
    def build(t):
        return hist.snapshot(history(t), commits(t), tenths(t, k)).select("key", "insert_ts", "value")

    build.__doc__ = f"What a reader after {k} tenths of the log sees, by each worker's last commit before it."


_at("snapshot_early", 1, "TX-01 TX-02 TX-04 RD-04")
_at("snapshot_middle", 5, "TX-01 TX-02 TX-04 RD-04")
_at("snapshot_late", 10, "TX-01 TX-02 RD-05")


@register("snapshot_point", "RD-01 FLT-01", "WITH" + HISTORY_SQL + ", " + _LCB.format(at=T_MID) + f" SELECT * FROM ({_SNAP}) WHERE key = 7")
def snapshot_point(t):
    """A time-travel point read: the key is filtered before anything is joined."""
    return hist.snapshot(history(t).where("key = 7"), commits(t), tenths(t, 5)).select("key", "insert_ts", "value")


@register("snapshot_interval_form", "TX-01", "WITH" + HISTORY_SQL + f" SELECT key, insert_ts, value FROM history WHERE NOT insert_invalid AND ins_commit < {T_MID} AND (del_commit IS NULL OR del_commit >= {T_MID})")
def snapshot_interval_form(t):
    """The same snapshot by half-open validity in commit time."""
    timed = hist.with_commit_times(history(t), commits(t))
    return timed.where(hist.visible_at(tenths(t, 5))).select("key", "insert_ts", "value")


@register("lcb_progress", "TX-02 TX-03", "WITH" + OPS_SQL + f" SELECT worker, CAST(coalesce(max(CASE WHEN ts_commit < {T_MID} THEN ts_commit END), 0) AS bigint) AS lcb FROM commits GROUP BY worker")
def lcb_progress(t):
    return hist.progress(commits(t), tenths(t, 5))


@register("phantom_versions", "TX-23", "WITH" + HISTORY_SQL + f" SELECT key, insert_worker, insert_ts FROM history WHERE insert_invalid AND insert_ts <= {T_MID}")
def phantom_versions(t):
    return hist.phantoms(history(t), tenths(t, 5)).select("key", "insert_worker", "insert_ts")


@register("physical_snapshot", "TX-24", "WITH" + HISTORY_SQL + " SELECT key, insert_ts, insert_invalid, value FROM history QUALIFY row_number() OVER (PARTITION BY key ORDER BY insert_ts DESC) = 1")
def physical_snapshot(t):
    return hist.physical(history(t)).select("key", "insert_ts", "insert_invalid", "value")


@register(
    "worker_activity",
    "TX-25",
    "WITH" + HISTORY_SQL + """, c AS (SELECT worker, count(*) AS commits FROM commits GROUP BY worker),
w2 AS (SELECT insert_worker AS worker, count(DISTINCT (key, insert_ts)) AS writes FROM history GROUP BY 1),
d AS (SELECT delete_worker AS worker, count(DISTINCT (key, delete_ts)) AS deletes FROM history WHERE delete_ts IS NOT NULL GROUP BY 1)
SELECT coalesce(c.worker, w2.worker, d.worker) AS worker, coalesce(commits, 0) AS commits, coalesce(writes, 0) AS writes, coalesce(deletes, 0) AS deletes
FROM c FULL JOIN w2 ON c.worker = w2.worker FULL JOIN d ON coalesce(c.worker, w2.worker) = d.worker""",
)
def worker_activity(t):
    return hist.activity(history(t), commits(t))


@register("clock_info", "TX-26", "WITH" + HISTORY_SQL + " SELECT greatest(max(insert_ts), max(delete_ts)) AS last_ts, greatest(max(insert_ts), max(delete_ts)) + 1 AS next_ts, greatest(max(insert_worker), max(delete_worker)) AS max_worker FROM history")
def clock_info(t):
    return hist.clock(history(t))


@register("root_for_version", "RD-21 RD-22 JN-09", "SELECT e.event_id AS asked, o.o_orderkey AS root FROM events e ASOF LEFT JOIN orders o ON e.event_id >= o.o_orderkey")
def root_for_version(t):
    """Predecessor search for many versions: the newest root at or before each."""
    roots = t("orders").select(F.lit(0).alias("tree"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("root"))
    asked = t("events").select(F.lit(0).alias("tree"), F.col("event_id").alias("asked"))
    return hist.asof(asked, roots, ["tree"], "asked", "at", ["root"], width=1000).select("asked", "root")


@register("staleness", "TX-21 ST-07", "SELECT event_id AS at, greatest((SELECT max(event_id) + 1 FROM events) // 2 - event_id, 0)::bigint AS stale FROM events")
def staleness(t):
    return t("events").select(F.col("event_id").alias("at"), hist.staleness(F.lit(span(t) // 2).cast("long"), F.col("event_id")).alias("stale"))


_COUNTS = (
    "WITH" + HISTORY_SQL + ", v AS (SELECT (max(event_id) + 1) * k + 3 AS a FROM events, (VALUES " + ", ".join(f"({k})" for k in TIMES) + """) x(k) GROUP BY k
UNION ALL SELECT 10 * (max(event_id) + 1) - 1 FROM events)
SELECT a AS at, count(h.key) AS n FROM v LEFT JOIN history h ON NOT insert_invalid AND ins_commit < a AND (del_commit IS NULL OR del_commit >= a) GROUP BY a"""
)


@register("counts_at_many_T", "RH DS", _COUNTS)
def counts_at_many_t(t):
    """Visible rows at several times, in one pass over the history."""
    return hist.counts_at(timed_history(t), [*(tenths(t, k) for k in TIMES), 10 * span(t) - 1])


@register("historic_count_stable", "HS", "WITH" + HISTORY_SQL + f" SELECT p.part AS part, count(h.key) AS n FROM (VALUES ('whole'), ('then')) p(part) LEFT JOIN history h ON NOT insert_invalid AND ins_commit < {T_MID} AND (del_commit IS NULL OR del_commit >= {T_MID}) GROUP BY p.part")
def historic_count_stable(t):
    """A count at a fixed time is the same over the whole history and over what
    had been written by then."""
    at, whole = tenths(t, 5), timed_history(t)
    then = whole.where(F.col("ins_commit") < at).withColumn("del_commit", F.when(F.col("del_commit") < at, F.col("del_commit")))
    count = lambda rows, part: rows.where(hist.visible_at(at)).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count(whole, "whole").unionByName(count(then, "then"))
