"""Calls of the engine's interface as queries: transactions that are asked for
step by step, visitors and folds, and files that are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generators as g
from ..functions import keys
from ..operators import changes, reads, retention
from ..operators.database import Database, Step, what_if
from ..sources import dumps, wal
from ..sources.shared import new_folder
from .base import OPS_SQL, TENTHS_SQL, tenths, transactions
from .registry import register


def _nations(t) -> Database:
    """A database with the nations: key, and the region as value."""
    db = Database(t.spark)
    db.create("nation")
    rows = t("nation").select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_nationkey").cast("long").alias("key"), F.lit("I").alias("op"), F.col("n_regionkey").cast("long").alias("value"))
    db.apply("nation", rows)
    return db


@register(
    "dispatch_operations",
    "RD-23",
    """SELECT * FROM (VALUES (1, 'insert', 'KeyAlreadyExists', 0::bigint), (2, 'update', 'Updated', 0), (3, 'delete', 'KeyDoesNotExist', 0)) v(step, kind, outcome, n)
UNION ALL SELECT 4, 'point', NULL, count(*) FILTER (WHERE n_nationkey = 3) FROM nation UNION ALL SELECT 5, 'range', NULL, count(*) FILTER (WHERE n_nationkey BETWEEN 5 AND 9) FROM nation""",
)
def dispatch_operations(t):
    """Single operations, each a transaction of its own."""
    db = _nations(t)
    writes = (("insert", 3), ("update", 3), ("delete", 900))
    rows = [(i + 1, kind, db.dispatch("nation", kind, key, value=99), 0) for i, (kind, key) in enumerate(writes)]
    rows += [(4, "point", None, db.dispatch("nation", "point", 3).count()), (5, "range", None, db.dispatch("nation", "range", 5, 9).count())]
    return t.spark.createDataFrame(rows, "step int, kind string, outcome string, n long")


@register(
    "what_if_steps",
    "TX-22",
    """SELECT * FROM (VALUES ('si', 1, 'found', 1::bigint), ('si', 3, 'updated', 1), ('si', 4, 'filtered', 0), ('si', 5, 'deleted', 1), ('si', 6, 'missing', 0), ('si', 7, 'inserted', 1), ('si', 8, 'conflict', 1),
  ('ru', 1, 'found', 1), ('ru', 3, 'updated', 1), ('ru', 4, 'filtered', 0), ('ru', 5, 'deleted', 1), ('ru', 6, 'missing', 0), ('ru', 7, 'inserted', 1), ('ru', 8, 'conflict', 1)) v(mode, step, status, n)
UNION ALL SELECT m, 2, 'matched', count(*) FILTER (WHERE n_nationkey BETWEEN 5 AND 9 AND n_regionkey = 2) FROM nation, (VALUES ('si'), ('ru')) x(m) GROUP BY m""",
)
def what_if_steps(t):
    """A transaction's steps without its writes being kept, until it is aborted."""
    db = _nations(t)
    steps = [
        Step("read", "nation", 3),
        Step("scan", "nation", 5, 9, where=F.col("value") == 2),
        Step("update", "nation", 3, values={"value": 99}),
        Step("read", "nation", 3, where=F.col("value") < 99),
        Step("delete", "nation", 4),
        Step("read", "nation", 4),
        Step("insert", "nation", 900, values={"value": 1}),
        Step("insert", "nation", 900, values={"value": 2}),
        Step("read", "nation", 1),
    ]
    rows = [(mode, i + 1, status, len(found)) for mode in ("si", "ru") for i, (status, found) in enumerate(what_if(db, steps, mode)[0])]
    return t.spark.createDataFrame(rows, "mode string, step int, status string, n long")


@register("early_stop_visit", "RD-08", "WITH e AS (SELECT min(o_orderkey) AS e FROM orders WHERE o_orderkey >= 100 AND o_custkey % 997 = 3) SELECT count(*) AS visited, max(o_orderkey) AS last_key FROM orders, e WHERE o_orderkey >= 100 AND (e IS NULL OR o_orderkey <= e)")
def early_stop_visit(t):
    """Orders that a visitor sees in order of key until one makes it stop."""
    rows = t("orders").select("o_orderkey", "o_custkey").where("o_orderkey >= 100")
    seen = reads.visited_until(rows, "o_orderkey", F.col("o_custkey") % 997 == 3)
    return seen.agg(F.count("*").alias("visited"), F.max("o_orderkey").alias("last_key"))


@register("user_fold", "RD-16", "SELECT count(*) AS n, sum(o_custkey)::bigint AS total, bit_xor(o_orderkey) AS mixed FROM orders")
def user_fold(t):
    """A fold by functions of the caller: partial states, merged."""

    def step(state, batch):
        import numpy as np

        key, cust = (batch.column(i).to_numpy() for i in (0, 1))
        return state[0] + len(key), state[1] + int(cust.sum()), state[2] ^ int(np.bitwise_xor.reduce(key, initial=0))

    found = reads.fold_with(t("orders").select("o_orderkey", "o_custkey"), lambda: (0, 0, 0), step, lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] ^ b[2]))
    return t.spark.createDataFrame([found], "n long, total long, mixed long")


# Own writes ------------------------------------------------------------------

_TXN = """s AS (SELECT event_id AS seq, event_id // 10 AS txn, user_id % 50 AS key, CASE event_type WHEN 'signup' THEN 'I' WHEN 'purchase' THEN 'D' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events),
b AS (SELECT n_nationkey::bigint AS key FROM nation),
a AS (SELECT seq, txn, key, op FROM s UNION ALL SELECT DISTINCT -1, txn, b.key, 'I' FROM s JOIN b ON s.key = b.key),
w AS (SELECT *, last_value(CASE WHEN op IN ('I', 'D') THEN op END IGNORE NULLS) OVER k AS prev, max(op = 'I') OVER k AS ever FROM a WINDOW k AS (PARTITION BY txn, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
done AS (SELECT seq, txn, key, op, CASE op WHEN 'I' THEN CASE WHEN prev = 'I' THEN 'KeyAlreadyExists' ELSE 'Inserted' END
  WHEN 'U' THEN CASE WHEN prev = 'I' THEN 'Updated' WHEN ever THEN 'KeyAlreadyDeleted' ELSE 'KeyDoesNotExist' END
  ELSE CASE WHEN prev = 'I' THEN 'Deleted' WHEN ever THEN 'KeyAlreadyDeleted' ELSE 'KeyDoesNotExist' END END AS outcome FROM w WHERE seq >= 0)"""


def _own(t):
    """Outcomes of the statements of transactions of ten on the nations."""
    e = F.col("event_type")
    op = F.when(e == "signup", "I").when(e.isin("purchase", "error"), "D").otherwise("U")
    s = t("events").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 10).alias("txn"), (F.col("user_id") % 50).alias("key"), op.alias("op"))
    return changes.own_outcomes(s, t("nation").select(F.col("n_nationkey").cast("long").alias("key")))


@register("own_write_outcomes", "TX-09", f"WITH {_TXN} SELECT seq, txn, key, op, outcome FROM done")
def own_write_outcomes(t):
    """What each statement meets: the transaction's own last write of the key,
    or else whether the table holds it."""
    return _own(t).select("seq", "txn", "key", "op", "outcome")


@register("commit_timestamps", "TX-10", f"WITH {_TXN}, g AS (SELECT txn, count(*) FILTER (WHERE outcome IN ('Inserted', 'Updated', 'Deleted')) AS writes FROM done GROUP BY txn) SELECT txn, writes, CASE WHEN writes > 0 THEN txn * 100 + 99 END AS ts_commit FROM g")
def commit_timestamps(t):
    """A transaction that wrote nothing draws no commit time."""
    g = _own(t).groupBy("txn").agg(F.count_if(F.col("outcome").isin(*changes.EFFECTIVE)).alias("writes"))
    return g.select("txn", "writes", F.when(F.col("writes") > 0, F.col("txn") * 100 + 99).alias("ts_commit"))


_BASE = """base AS (SELECT o_orderkey AS key, o_custkey AS value FROM orders), own AS (SELECT event_id * 3 AS key, event_type = 'purchase' AS deleted, user_id AS value FROM events),
seen AS (SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM own) UNION ALL SELECT key, value FROM own WHERE NOT deleted)"""


@register("own_write_terminals", "RD-18 RD-19", f"WITH {_BASE} SELECT count(*) AS n, sum(value)::bigint AS total, min(key) AS first_key, arg_min(value, key) AS first_value, count(*) FILTER (WHERE value % 2 = 0) AS even FROM seen WHERE key BETWEEN 5 AND 9000")
def own_write_terminals(t):
    """Count, fold and first key of a range, with a transaction's own writes on top."""
    base = t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"))
    own = t("events").select((F.col("event_id") * 3).alias("key"), F.col("user_id").alias("value"), (F.col("event_type") == "purchase").alias("deleted"))
    seen = changes.overlay(reads.scan(base, "key", 5, 9000), reads.scan(own, "key", 5, 9000))
    return seen.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("key").alias("first_key"), F.min_by("value", "key").alias("first_value"), F.count_if(F.col("value") % 2 == 0).alias("even"))


_AT = TENTHS_SQL.format(k=5)


@register(
    "committed_writer_tests",
    "TX-16",
    "WITH" + OPS_SQL + f""", ended AS (SELECT worker, max(ts_end) AS e, max(CASE WHEN op <> 'X' THEN ts_end END) AS c FROM txn WHERE ts_end < {_AT} GROUP BY worker)
SELECT seq, coalesce(op <> 'X' AND e > ts_start, false) AS auto_commit, coalesce(op <> 'X' AND c > ts_start, false) AS retention FROM txn t LEFT JOIN ended x ON t.worker = x.worker""",
)
def committed_writer_tests(t):
    """Two tests of whether a stamp's writer has committed: that its worker has
    since ended a transaction, and that it has since committed one."""
    rows = transactions(t)
    past = rows.where(F.col("ts_end") < tenths(t, 5))
    ended = past.groupBy("worker").agg(F.max("ts_end").alias("e"), F.max(F.when(F.col("op") != "X", F.col("ts_end"))).alias("c"))
    test = lambda last: retention.committed_writer(F.col(last), F.col("ts_start"), F.col("op") == "X")
    return rows.join(ended, "worker", "left").select("seq", test("e").alias("auto_commit"), test("c").alias("retention"))


@register("nurand_customers", "RNG", "SELECT event_id, ((event_id * 7919 % 1024) | (1 + event_id * 104729 % 3000)) AS mixed, ((((event_id * 7919 % 1024) | (1 + event_id * 104729 % 3000)) + 259) % 3000) + 1 AS c_id FROM events")
def nurand_customers(t):
    """Non-uniform draws of customers from two uniform ones."""
    a, x = F.col("event_id") * 7919 % 1024, 1 + F.col("event_id") * 104_729 % 3000
    return t("events").select("event_id", a.bitwiseOR(x).alias("mixed"), g.nurand_of(a, x, 1, 3000, 259).alias("c_id"))


_DIGIT = "greatest(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', upper(substr(rpad(p_name, 3, '0'), {i}, 1))) - 1, 0)"


@register("first_name_codes", "RNG", f"SELECT p_partkey, ({_DIGIT.format(i=1)} * 1296 + {_DIGIT.format(i=2)} * 36 + {_DIGIT.format(i=3)})::bigint AS code FROM part")
def first_name_codes(t):
    """The first three letters or digits of a name as a number in base 36."""
    return t("part").select("p_partkey", keys.first_name_code("p_name").alias("code"))


# Files -----------------------------------------------------------------------

_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@register("catalog_roundtrip", "SRC-07", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES)) + ") v(table_id, name)")
def catalog_roundtrip(t):
    """Names of tables, one a line in order of creation; a table's id is its line."""
    path = new_folder(t.spark, "catalog")
    dumps.write_catalog(t.spark, list(_NAMES), path)
    return dumps.read_catalog(t.spark, path)


@register(
    "latency_file",
    "SNK-07 RA-06",
    "SELECT event_type AS operation, count(*) AS count, min(event_id)::DOUBLE AS p50_us, max(event_id)::DOUBLE AS p95_us, NULL::DOUBLE AS p99_us, round(avg(user_id), 3) AS avg_us, 64::bigint AS sample_every FROM events GROUP BY 1 HAVING event_type = 'view'",
)
def latency_file(t):
    """A summary file, and one operation's row read back from it."""
    path = new_folder(t.spark, "latency")
    rows = t("events").groupBy(F.col("event_type").alias("operation")).agg(F.count("*").alias("count"), F.min("event_id").alias("p50_us"), F.max("event_id").alias("p95_us"), F.round(F.avg("user_id"), 3).alias("avg_us"))
    dumps.write_results(rows.withColumn("sample_every", F.lit(64)), path, "latency")
    return dumps.read_results(t.spark, path, "latency").where("operation = 'view'")


@register("scan_file", "SNK-07", "SELECT 'historic' AS mode, event_id::DOUBLE AS elapsed_secs, 0.5::DOUBLE AS delay_secs, event_id * 10 AS snapshot, user_id AS scanned_tuples, event_id + 1 AS latency_ns, NULL::DOUBLE AS tuples_per_sec, 'a,\"b\"' AS summary, NULL::bigint AS staleness_versions FROM events")
def scan_file(t):
    """A scan file with a quoted summary and empty cells, read back."""
    path = new_folder(t.spark, "scans")
    i = F.col("event_id")
    rows = t("events").select(F.lit("historic").alias("mode"), i.alias("elapsed_secs"), F.lit(0.5).alias("delay_secs"), (i * 10).alias("snapshot"), F.col("user_id").alias("scanned_tuples"), (i + 1).alias("latency_ns"), F.lit('a,"b"').alias("summary"))
    dumps.write_results(rows, path, "scan")
    return dumps.read_results(t.spark, path, "scan")


@register(
    "manifest_file",
    "SNK-08 RA-09",
    "SELECT 'e' || user_id % 3 AS engine, event_type AS workload, r AS threads, r = 1 AS gc_enabled, count(*)::DOUBLE AS primary_metric_value, 'process_rss' AS memory_source, 17 AS columns FROM events, (VALUES (1::bigint), (2::bigint)) x(r) GROUP BY ALL",
)
def manifest_file(t):
    """Two runs appended to one manifest of 17 columns."""
    path = new_folder(t.spark, "manifest")
    rows = t("events").groupBy((F.concat(F.lit("e"), F.col("user_id") % 3)).alias("engine"), F.col("event_type").alias("workload")).agg(F.count("*").alias("primary_metric_value"))
    for run in (1, 2):
        dumps.append_manifest(rows.withColumns({"threads": F.lit(run), "gc_enabled": F.lit(run == 1), "memory_source": F.lit("process_rss")}), path)
    back = dumps.read_results(t.spark, path, "manifest")
    return back.select("engine", "workload", "threads", "gc_enabled", "primary_metric_value", "memory_source", F.lit(len(back.columns)).alias("columns"))


@register(
    "wal_shards",
    "SNK-02 SNK-04",
    "WITH" + OPS_SQL + """, r AS (SELECT worker % 4 AS shard, ts_start, CASE WHEN op <> 'X' THEN ts_end END AS ts_commit FROM txn)
SELECT shard::bigint AS shard, count(*) FILTER (WHERE ts_commit IS NOT NULL) AS commits, count(*) AS writes, max(ts_start) AS written, max(ts_commit) AS hardened FROM r GROUP BY 1""",
)
def wal_shards(t):
    """A log in four shards of batches: what each holds, read back, and the
    commit up to which it is durable."""
    rows = transactions(t)
    none = F.lit(None).cast("long")
    write = rows.select(F.col("seq"), F.when(F.col("op") == "X", "U").otherwise(F.col("op")).alias("op"), "worker", "ts_start", "key", F.when(F.col("op") != "D", F.col("seq")).alias("payload"), none.alias("ts_commit"))
    mark = rows.where("op <> 'X'").select("seq", F.lit("C").alias("op"), "worker", "ts_start", none.alias("key"), none.alias("payload"), F.col("ts_end").alias("ts_commit"))
    log = write.unionByName(mark).withColumn("table_id", F.lit(1).cast("long")).withColumn("order", F.col("seq") * 2 + (F.col("op") == "C").cast("int"))
    shard = F.col("worker") % wal.SHARDS
    files = wal.encode(log.withColumn("segment", F.concat_ws("-", shard, F.floor(F.col("seq") / wal.BATCH))), order="order")
    back = wal.decode(files.withColumnRenamed("segment", "path"))
    g = back.groupBy(F.split("segment", "-")[0].cast("long").alias("shard"))
    is_mark = F.col("op") == "C"
    return g.agg(F.count_if(is_mark).alias("commits"), F.count_if(~is_mark).alias("writes"), F.max(F.when(~is_mark, F.col("ts_start"))).alias("written"), F.max("ts_commit").alias("hardened"))
