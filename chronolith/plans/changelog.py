"""Replay of change logs, own writes, upserts and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, conflicts
from .base import HISTORY_SQL, OPS_SQL, SLICE, TENTHS_SQL, cents, commits, commits_of, history, ops, outcomes, tenths, timed_history, transactions
from .registry import register


@register("replay_outcomes", "TX-13 TX-15 WR-01 WR-02 WR-03 JN-07", "WITH" + HISTORY_SQL + " SELECT seq, key, op, outcome FROM done")
def replay_outcomes(t):
    """The outcome of each committed operation, in order of commit."""
    log = changes.committed(ops(t), commits(t))
    return changes.outcomes(log).select("seq", "key", "op", "outcome")


@register("replay_outcomes_sliced", "TX-15", "WITH" + HISTORY_SQL + " SELECT seq, key, op, outcome FROM done")
def replay_outcomes_sliced(t):
    """The same by slices of the log, so that a hot key is no single task's work."""
    log = changes.committed(ops(t), commits(t))
    return changes.outcomes(log, slice_by=F.floor(F.col("ts_commit") / SLICE)).select("seq", "key", "op", "outcome")


@register("outcome_counts", "T-MIX WR-06 TX-10", "WITH" + HISTORY_SQL + " SELECT outcome, count(*) AS n FROM done GROUP BY outcome")
def outcome_counts(t):
    return outcomes(t).groupBy("outcome").agg(F.count("*").alias("n"))


@register("replay_final_state", "TX-13 TX-15", "WITH" + HISTORY_SQL + " SELECT key, value FROM (SELECT * FROM eff QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_commit DESC, seq DESC) = 1) WHERE op <> 'D'")
def replay_final_state(t):
    return changes.final_state(outcomes(t), payload=["value"])


@register(
    "replay_by_table",
    "TX-12 TX-14 SRC-05",
    "WITH" + OPS_SQL + """, log AS (SELECT event_id % 3 AS table_id, o.* FROM txn o JOIN events e ON o.seq = e.event_id WHERE op <> 'X'),
w AS (SELECT *, last_value(CASE WHEN op IN ('I', 'D') THEN op END IGNORE NULLS) OVER b AS prev FROM log
      WINDOW b AS (PARTITION BY table_id, key ORDER BY ts_end, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT table_id, count(*) FILTER (WHERE op = 'I' AND prev IS DISTINCT FROM 'I') AS inserted, count(*) FILTER (WHERE op = 'U' AND prev = 'I') AS updated, count(*) FILTER (WHERE op = 'D' AND prev = 'I') AS deleted
FROM w GROUP BY table_id""",
)
def replay_by_table(t):
    """One log of three tables, told apart by table_id, under shared commits."""
    log = changes.committed(ops(t), commits(t)).withColumn("table_id", F.col("seq") % 3)
    done = changes.outcomes(log, keys=["table_id", "key"])
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x.lower())
    return done.groupBy("table_id").agg(*map(count, changes.EFFECTIVE))


@register("aborted_writes_hidden", "TX-11", "WITH" + HISTORY_SQL + """, bad AS (SELECT worker, ts_start FROM ops WHERE seq % 5 = 0)
SELECT key, insert_ts, insert_invalid OR i.worker IS NOT NULL AS insert_invalid, CASE WHEN d.worker IS NULL THEN delete_ts END AS delete_ts
FROM history h LEFT JOIN bad i ON h.insert_worker = i.worker AND h.insert_ts = i.ts_start LEFT JOIN bad d ON h.delete_worker = d.worker AND h.delete_ts = d.ts_start""")
def aborted_writes_hidden(t):
    """Rolling back every fifth transaction: its inserts become invalid, its
    deletions are undone."""
    bad = ops(t).where("seq % 5 = 0").select("worker", "ts_start")
    return changes.aborted(history(t), bad).select("key", "insert_ts", "insert_invalid", "delete_ts")


@register(
    "own_write_overlay",
    "TX-08 TX-09 RD-18 RD-19 JN-08",
    "WITH" + HISTORY_SQL + """, base AS (SELECT key, value FROM (SELECT * FROM eff QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_commit DESC, seq DESC) = 1) WHERE op <> 'D'),
own AS (SELECT user_id AS key, event_type = 'purchase' AS deleted, value * 2 AS value FROM events WHERE event_id % 20 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM own) UNION ALL SELECT key, value FROM own WHERE NOT deleted""",
)
def own_write_overlay(t):
    """What a transaction with writes of its own reads."""
    base = changes.final_state(outcomes(t), payload=["value"])
    statements = t("events").where("event_id % 20 = 1").select(F.lit(1).alias("txn"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "D").otherwise("U").alias("op"), (F.col("value") * 2).alias("value"))
    return changes.overlay(base, changes.own_writes(statements).select("key", "value", "deleted"))


@register(
    "upsert_new_vs_late",
    "WR-08 ST-03 GEN-06",
    "WITH a AS (SELECT event_id AS seq, greatest(1, event_id - event_id * 7 % 40) AS key FROM events) SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY seq) = 1 AS was_new FROM a",
)
def upsert_new_vs_late(t):
    """Near-sorted arrivals: the first arrival of a key is new, others are late
    upserts.  First arrivals come from an aggregate, not from a sort."""
    a = t("events").select(F.col("event_id").alias("seq"), F.greatest(F.lit(1).cast("long"), F.col("event_id") - F.col("event_id") * 7 % 40).alias("key"))
    first = a.groupBy("key").agg(F.min("seq").alias("first"))
    return a.join(first, "key").select("seq", "key", (F.col("seq") == F.col("first")).alias("was_new"))


@register(
    "upsert_result",
    "WR-08",
    "WITH a AS (SELECT greatest(1, event_id - event_id * 7 % 40) AS o_orderkey, event_id AS seq, user_id AS o_custkey FROM events), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1) SELECT coalesce(o.o_orderkey, l.o_orderkey) AS o_orderkey, coalesce(l.o_custkey, o.o_custkey) AS o_custkey FROM (SELECT o_orderkey, o_custkey FROM orders) o FULL JOIN l ON o.o_orderkey = l.o_orderkey",
)
def upsert_result(t):
    """The table after the arrivals; the last arrival wins, not the latest event."""
    arrivals = t("events").select(F.greatest(F.lit(1).cast("long"), F.col("event_id") - F.col("event_id") * 7 % 40).alias("o_orderkey"), F.col("event_id").alias("seq"), F.col("user_id").alias("o_custkey"))
    return changes.upsert(t("orders").select("o_orderkey", "o_custkey"), arrivals, "o_orderkey", "seq")


_ASKED = "SELECT CASE WHEN event_id % 10 = 0 THEN -1 - event_id ELSE event_id // 2 END AS k, event_id, CAST(floor(value * 100 + 0.5) AS bigint) AS a FROM events"


@register(
    "update_with_latest",
    "WR-04",
    f"WITH r AS ({_ASKED}), g AS (SELECT k, sum(a)::bigint AS added, count(*) AS n FROM r GROUP BY k) SELECT k AS o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS bigint) + added AS cents, o_custkey + n AS touched, CASE WHEN o_orderkey IS NULL THEN 'KeyDoesNotExist' ELSE 'Updated' END AS outcome FROM g LEFT JOIN orders ON k = o_orderkey",
)
def update_with_latest(t):
    """Totals that grow by what events ask for, each from the latest one."""
    base = t("orders").select("o_orderkey", cents("o_totalprice").alias("cents"), F.col("o_custkey").alias("touched"))
    i = F.col("event_id")
    asked = t("events").select(F.when(i % 10 == 0, -1 - i).otherwise(F.floor(i / 2)).alias("o_orderkey"), cents("value").alias("a"))
    grown = {"cents": F.col("cents") + F.col("added"), "touched": F.col("touched") + F.col("n")}
    return changes.update_with(base, asked, "o_orderkey", [F.sum("a").alias("added"), F.count("*").alias("n")], grown)


_ROW = "rpad(o_orderstatus, 4, '.') || rpad(o_orderpriority, 4, '.') || lpad((o_custkey % 10000)::varchar, 4, '0')"


@register(
    "read_modify_write",
    "WR-09 WR-10",
    f"""WITH w AS (SELECT event_id // 3 AS k, event_id AS i, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 END AS f, lpad((event_id % 10000)::varchar, 4, '0') AS p FROM events),
s AS (SELECT k, max(i) FILTER (WHERE f IS NULL) AS s, count(*) AS writes FROM w GROUP BY k),
l AS (SELECT w.k, any_value(writes) AS writes, any_value(s) AS s, arg_max(p, i) FILTER (WHERE f = 0 AND i > coalesce(s, -1)) AS p0, arg_max(p, i) FILTER (WHERE f = 1 AND i > coalesce(s, -1)) AS p1,
      arg_max(p, i) FILTER (WHERE f = 2 AND i > coalesce(s, -1)) AS p2 FROM w JOIN s ON w.k = s.k GROUP BY w.k),
b AS (SELECT o_orderkey AS key, {_ROW} AS old FROM orders),
x AS (SELECT key, CASE WHEN s IS NULL THEN old ELSE repeat(lpad((s % 10000)::varchar, 4, '0'), 3) END AS r, p0, p1, p2, writes FROM b JOIN l ON key = k)
SELECT key, coalesce(p0, substr(r, 1, 4)) || coalesce(p1, substr(r, 5, 4)) || coalesce(p2, substr(r, 9, 4)) AS row, writes FROM x""",
)
def read_modify_write(t):
    """Rows of three fields after writes of one field, and of the whole row."""
    row = F.concat(F.rpad("o_orderstatus", 4, "."), F.rpad("o_orderpriority", 4, "."), F.lpad((F.col("o_custkey") % 10_000).cast("string"), 4, "0"))
    base = t("orders").select(F.col("o_orderkey").alias("key"), row.alias("row"))
    i = F.col("event_id")
    one = F.lpad((i % 10_000).cast("string"), 4, "0")
    field = F.when(i % 7 != 0, i % 3)
    writes = t("events").select(F.floor(i / 3).alias("key"), i.alias("seq"), field.alias("field"), F.when(field.isNull(), F.repeat(one, F.lit(3))).otherwise(one).alias("patch"))
    return changes.read_modify_write(base, writes, "key", "seq", 3, 4)


@register("history_collapsed", "WR-07", "WITH" + HISTORY_SQL + " SELECT key, insert_ts FROM history WHERE del_commit IS NULL OR (ins_commit < " + TENTHS_SQL.format(k=3) + " AND del_commit >= " + TENTHS_SQL.format(k=3) + ") OR (ins_commit < " + TENTHS_SQL.format(k=7) + " AND del_commit >= " + TENTHS_SQL.format(k=7) + ")")
def history_collapsed(t):
    """Versions that no snapshot could see are left out."""
    return changes.collapse(timed_history(t), [tenths(t, 3), tenths(t, 7)]).select("key", "insert_ts")


_WRITES = "writes AS (SELECT event_id AS seq, user_id % 8 AS key, event_id % 16 AS worker, event_id * 10 AS ts_start, event_id * 10 AS read_ts, event_id * 10 + 55 AS ts_commit FROM events WHERE event_type <> 'error')"


def _writes(t):
    i = F.col("event_id")
    return t("events").where("event_type <> 'error'").select(i.alias("seq"), (F.col("user_id") % 8).alias("key"), (i % 16).alias("worker"), (i * 10).alias("ts_start"), (i * 10).alias("read_ts"), (i * 10 + 55).alias("ts_commit"))


@register(
    "first_writer_conflicts",
    "TX-06",
    "WITH " + _WRITES + """, p AS (SELECT a.seq, a.read_ts, max(b.seq) AS other FROM writes a LEFT JOIN writes b ON a.key = b.key AND b.seq < a.seq AND a.worker <> b.worker GROUP BY 1, 2)
SELECT p.seq, coalesce(NOT (b.ts_commit < p.read_ts), false) AS conflict FROM p LEFT JOIN writes b ON p.other = b.seq""",
)
def first_writer_conflicts(t):
    """Writes whose key was last written by a transaction they cannot see."""
    return conflicts.first_writer(_writes(t)).select("seq", "conflict")


@register(
    "auto_commit_conflicts",
    "TX-07 TX-16",
    "WITH " + _WRITES + ", w AS (SELECT seq, worker, ts_start + 1 AS ts_write, lag(ts_commit) OVER k AS e, lag(worker) OVER k AS o FROM writes WINDOW k AS (PARTITION BY key ORDER BY seq)) SELECT seq, coalesce(o <> worker AND e >= ts_write, false) AS conflict FROM w",
)
def auto_commit_conflicts(t):
    """Writes that meet a transaction still running."""
    rows = _writes(t).withColumn("ts_end", F.col("ts_commit")).withColumn("ts_write", F.col("ts_start") + 1)
    return conflicts.auto_commit(rows).select("seq", "conflict")


@register(
    "serial_winners",
    "TX-06",
    "WITH RECURSIVE " + _WRITES + """, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM writes),
f AS (SELECT key, n, seq, worker, false AS lost, worker AS w1, ts_commit AS c1, NULL::bigint AS w2, NULL::bigint AS c2 FROM w WHERE n = 1
      UNION ALL
      SELECT key, n, seq, worker, lost, CASE WHEN lost THEN w1 ELSE worker END, CASE WHEN lost THEN c1 ELSE ts_commit END,
             CASE WHEN NOT lost AND w1 <> worker THEN w1 ELSE w2 END, CASE WHEN NOT lost AND w1 <> worker THEN c1 ELSE c2 END
      FROM (SELECT w.key, w.n, w.seq, w.worker, w.ts_commit, f.w1, f.c1, f.w2, f.c2,
                   coalesce(CASE WHEN f.w1 <> w.worker THEN f.c1 ELSE f.c2 END >= w.read_ts, false) AS lost
            FROM f JOIN w ON w.key = f.key AND w.n = f.n + 1))
SELECT key, seq, worker, lost AS conflict FROM f""",
)
def serial_winners(t):
    """First writer wins with cascading rollbacks, key by key."""
    return conflicts.serial_winners(_writes(t))


@register(
    "read_committed_reads",
    "TX-05",
    "WITH" + OPS_SQL + ", c AS (SELECT key, ts_end AS ts_commit, value FROM txn WHERE op <> 'X'), s AS (SELECT event_id AS id, user_id AS key, event_id * 10 + 3 AS ts FROM events) SELECT s.id, s.key, arg_max(c.value, c.ts_commit) AS value FROM s LEFT JOIN c ON s.key = c.key AND c.ts_commit < s.ts GROUP BY s.id, s.key",
)
def read_committed_reads(t):
    """Statements that each read what was committed before their own time."""
    versions = transactions(t).where("op <> 'X'").select("key", F.col("ts_end").alias("ts_commit"), "value")
    statements = t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), (F.col("event_id") * 10 + 3).alias("ts"))
    return conflicts.read_committed(statements, versions).select("id", "key", "value")
