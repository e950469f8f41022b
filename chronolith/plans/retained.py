"""Retention, commit-log pruning and garbage metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import percentiles as pc
from ..operators import metrics
from ..operators import retention as keep
from .base import HISTORY_SQL, OPS_SQL, TENTHS_SQL, commits, history, tenths, timed_history, transactions
from .registry import register

#: Tenths of the log at which the questions are asked.
NOW, OLDEST = TENTHS_SQL.format(k=6), TENTHS_SQL.format(k=5.5)
SNAPSHOTS = (2, 4, 5.5)
LEAF = 10


@register("oldest_live_snapshot", "TX-17 TX-18", "WITH" + OPS_SQL + f" SELECT min(ts_start) AS oldest, max(ts_start) AS newest FROM txn WHERE ts_start <= {NOW} AND ts_end > {NOW}")
def oldest_live_snapshot(t):
    return keep.live_snapshots(transactions(t), tenths(t, 6))


@register(
    "commit_log_pruned",
    "TX-19",
    "WITH" + OPS_SQL + f""" SELECT worker, max(ts_commit) AS ts_commit FROM commits GROUP BY worker
UNION SELECT worker, max(ts_commit) FROM commits WHERE ts_commit < {OLDEST} GROUP BY worker UNION SELECT worker, ts_commit FROM commits WHERE ts_commit >= {OLDEST}
UNION SELECT worker, max(ts_commit) FROM commits, ({" UNION ALL ".join("SELECT " + TENTHS_SQL.format(k=s) + " AS a" for s in SNAPSHOTS)}) v WHERE ts_commit < a GROUP BY worker, a""",
)
def commit_log_pruned(t):
    return keep.pruned_commits(commits(t), [tenths(t, s) for s in SNAPSHOTS], tenths(t, 5.5))


@register(
    "retained_versions",
    "TX-20 ST-I5",
    "WITH" + HISTORY_SQL + f""", v AS (SELECT *, NOT (delete_ts IS NULL OR del_commit IS NULL) AS dead FROM history WHERE NOT insert_invalid)
SELECT key, insert_ts, delete_ts FROM (SELECT *, row_number() OVER (PARTITION BY key, dead ORDER BY insert_ts DESC) AS n FROM v) WHERE NOT dead OR (n = 1 AND del_commit >= {OLDEST})""",
)
def retained_versions(t):
    return keep.retained(timed_history(t), tenths(t, 5.5)).select("key", "insert_ts", "delete_ts")


_LEAVES = "WITH" + HISTORY_SQL + f""", leaves AS (SELECT key // {LEAF} AS leaf, count(*) FILTER (WHERE NOT (insert_invalid OR delete_ts IS NOT NULL)) AS live, count(*) FILTER (WHERE insert_invalid OR delete_ts IS NOT NULL) AS dead FROM history GROUP BY 1),
g AS (SELECT *, dead / (live + dead)::DOUBLE AS dead_ratio FROM leaves)"""


def _leaves(t):
    return keep.garbage(history(t), LEAF)


@register("garbage_ratio_by_bucket", "RD-17 MT-15", _LEAVES + " SELECT * FROM g")
def garbage_ratio_by_bucket(t):
    return _leaves(t)


@register("compaction_candidates", "MT-15 ST-I7", _LEAVES + " SELECT leaf, dead_ratio FROM g WHERE dead_ratio >= 0.98")
def compaction_candidates(t):
    return keep.compaction_candidates(_leaves(t), 0.98).select("leaf", "dead_ratio")


_CLASS = "CASE WHEN p >= 0.8 THEN 'overflow' WHEN p < 0.2 THEN 'strong_underflow' WHEN p < 0.4 THEN 'underflow' ELSE 'ok' END"
_FILL = _LEAVES + f", f AS (SELECT *, live + dead AS records, live / 600.0::DOUBLE AS logical_fill, (live + dead) / 600.0::DOUBLE AS p FROM g), fill AS (SELECT leaf, live, dead, records, logical_fill, p AS physical_fill, dead_ratio, {_CLASS} AS fill_class, logical_fill < 0.4 AS logical_underflow, dead_ratio >= 0.5 AS garbage_over FROM f)"


@register("node_filling", "MT-14", _FILL + " SELECT * FROM fill")
def node_filling(t):
    return keep.node_fill(_leaves(t), 600)


@register(
    "node_rows",
    "MT-09",
    "WITH" + HISTORY_SQL + f""", h AS (SELECT key // {LEAF} AS leaf, key, insert_invalid OR delete_ts IS NOT NULL AS dead FROM history),
l AS (SELECT leaf, count(*) FILTER (WHERE NOT dead) AS live, count(*) FILTER (WHERE dead) AS dead, min(key) FILTER (WHERE NOT dead) AS lo, max(key) FILTER (WHERE NOT dead) AS hi FROM h GROUP BY 1),
n AS (SELECT leaf::varchar AS node_id, 'root' AS parent_id, 1 AS depth, false AS is_root, 'leaf' AS node_type, live, dead, lo, hi FROM l
      UNION ALL SELECT 'root', '', 0, true, 'internal', count(*), 0, min(lo), max(hi) FROM l)
SELECT 'end' AS checkpoint, 'events' AS "table", node_id, parent_id, depth, is_root, node_type, 40 AS capacity, 40 AS overflow_threshold, live, dead, live + dead AS total,
live / 40.0::DOUBLE AS logical_fill, (live + dead) / 40.0::DOUBLE AS physical_fill, CASE WHEN live + dead > 0 THEN dead / (live + dead)::DOUBLE ELSE 0.0 END AS garbage_ratio,
8 AS weak_d, 16 AS strong_min, 32 AS strong_max, live < 16 AS below_strong_min, live > 32 AS above_strong_max, NOT is_root AND live BETWEEN 1 AND 7 AS strict_weak_violation,
NOT is_root AND live = 8 AS at_weak_boundary, NOT is_root AND live < 8 AS repair_due, live + dead >= 40 AS overflow_due, is_root AND live < 2 AS root_collapse_due,
coalesce(lo::varchar, '') AS min_key, coalesce(hi::varchar, '') AS max_key FROM n""",
)
def node_rows(t):
    """All 27 columns of every logical node."""
    return keep.node_rows(history(t), "events", "end", LEAF, 40)


@register(
    "node_fill_summary",
    "MT-10",
    _FILL + """, r AS (SELECT *, list_sort(list(physical_fill) OVER ()) AS s, count(*) OVER () AS n FROM fill)
SELECT count(*) AS leaves, avg(physical_fill) AS mean_fill, avg(dead_ratio) AS mean_dead, any_value(s[round(0.05 * (n - 1))::bigint + 1]) AS p05, any_value(s[round(0.5 * (n - 1))::bigint + 1]) AS p50, any_value(s[round(0.95 * (n - 1))::bigint + 1]) AS p95,
count(*) FILTER (WHERE fill_class = 'overflow') AS overflow, count(*) FILTER (WHERE logical_underflow) AS logical_underflow, count(*) FILTER (WHERE garbage_over) AS garbage_over FROM r""",
)
def node_fill_summary(t):
    """Means, nearest-rank percentiles and violations over the leaves."""
    f, x = keep.node_fill(_leaves(t), 600), F.col("physical_fill")
    asked = {n: ("nearest", p) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))}
    ranks = metrics.exact_percentiles(f, [], "physical_fill", asked).drop("n")
    return f.agg(
        F.count("*").alias("leaves"),
        F.avg(x).alias("mean_fill"),
        F.avg("dead_ratio").alias("mean_dead"),
        F.count_if(F.col("fill_class") == "overflow").alias("overflow"),
        F.count_if("logical_underflow").alias("logical_underflow"),
        F.count_if("garbage_over").alias("garbage_over"),
    ).crossJoin(ranks)  # single rows


@register("scan_trace", "MT-08", "WITH" + HISTORY_SQL + " SELECT key % 5 AS part, count(*) AS visited, count(*) FILTER (WHERE NOT insert_invalid AND delete_ts IS NULL) AS matched, CASE WHEN count(*) FILTER (WHERE NOT insert_invalid AND delete_ts IS NULL) > 0 THEN count(*) / count(*) FILTER (WHERE NOT insert_invalid AND delete_ts IS NULL)::DOUBLE ELSE 0.0 END AS ratio FROM history GROUP BY 1")
def scan_trace(t):
    """Versions visited against rows matched."""
    n, m = F.count("*"), F.count_if(~F.col("insert_invalid") & F.col("delete_ts").isNull())
    return history(t).groupBy((F.col("key") % 5).alias("part")).agg(n.alias("visited"), m.alias("matched"), pc.or_zero(n, m).alias("ratio"))
