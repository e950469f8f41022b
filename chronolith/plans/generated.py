"""Generators, binary sources and dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generators as g
from ..operators.retention import leaf
from ..sources import dumps, opfile, wal
from .base import HISTORY_SQL, history, span
from .registry import register


def _log(t):
    e, i = F.col("event_type"), F.col("event_id")
    op = F.when(e == "signup", "I").when(e == "purchase", "D").when(e == "error", "C").otherwise("U")
    rows = t("events").select((i % 7).alias("segment"), i.alias("seq"), (i % 3).alias("table_id"), op.alias("op"), (F.col("user_id") % 64).alias("worker"), (i * 10).alias("ts_start"), F.col("user_id").alias("k"))
    commit = F.col("op") == "C"
    return rows.select(
        "segment", "seq", F.when(~commit, F.col("table_id")).alias("table_id"), "op", "worker", "ts_start", F.when(~commit, F.col("k")).alias("key"),
        F.when(F.col("op").isin("I", "U"), F.col("seq") * 3).alias("payload"), F.when(commit, F.col("ts_start") + 55).alias("ts_commit"),
    )


@register(
    "wal_codec_roundtrip",
    "SRC-03 SRC-04 SRC-05 SNK-02",
    "WITH r AS (SELECT event_id AS seq, event_id % 3 AS tid, CASE event_type WHEN 'signup' THEN 'I' WHEN 'purchase' THEN 'D' WHEN 'error' THEN 'C' ELSE 'U' END AS op, user_id % 64 AS worker, event_id * 10 AS ts_start, user_id FROM events) SELECT CASE WHEN op <> 'C' THEN tid END AS table_id, op, worker, ts_start, CASE WHEN op <> 'C' THEN user_id END AS key, CASE WHEN op IN ('I', 'U') THEN seq * 3 END AS payload, CASE WHEN op = 'C' THEN ts_start + 55 END AS ts_commit FROM r",
)
def wal_codec_roundtrip(t):
    """A log of several tables, encoded, damaged in front of each segment, and
    read back."""
    files = wal.encode(_log(t).withColumn("table_id", F.coalesce("table_id", F.lit(0)))).select(F.col("segment").cast("string").alias("path"), F.concat(F.unhex(F.lit("0102FF")), F.col("content")).alias("content"))
    return wal.decode(files).select("table_id", "op", "worker", "ts_start", "key", "payload", "ts_commit")


@register("query_file_roundtrip", "SRC-08 SNK-01", "SELECT CASE event_type WHEN 'signup' THEN 'I' WHEN 'purchase' THEN 'D' ELSE 'U' END AS op, event_id * 1000003 AS key, count(*) AS n FROM events GROUP BY 1, 2")
def query_file_roundtrip(t):
    e, i = F.col("event_type"), F.col("event_id")
    ops = t("events").select(F.floor(i / 1000).alias("segment"), i.alias("seq"), F.when(e == "signup", "I").when(e == "purchase", "D").otherwise("U").alias("op"), (i * 1_000_003).alias("key"))
    back = opfile.decode(opfile.encode(ops).withColumnRenamed("segment", "path"))
    return back.groupBy("op", "key").agg(F.count("*").alias("n"))


@register("query_file_generated", "SNK-01 WR-05")
def query_file_generated(t):
    """Operations of a generated file by kind."""
    return opfile.generate(t.spark, 1000, 20, 500).groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@register("structure_dump", "SNK-05 TX-23", "WITH" + HISTORY_SQL + " SELECT key // 123 AS leaf, key, insert_worker, insert_ts, insert_invalid, delete_worker, delete_ts FROM history")
def structure_dump(t):
    """Versions written as JSON leaves and read back."""
    return dumps.read_leaves(dumps.leaves(history(t), leaf()))


@register(
    "explorer_bundle",
    "SNK-06",
    """WITH m AS (SELECT max(event_id) + 1 AS asked FROM events)
SELECT 'nation' AS "table", asked AS snapshot, 3 AS fields, count(*) AS n, sum(n_nationkey)::bigint AS keys, max(n_name) AS top FROM nation, m GROUP BY asked
UNION ALL SELECT 'orders', asked, 6, count(*), sum(o_orderkey)::bigint, max(o_orderpriority) FROM orders, m GROUP BY asked
UNION ALL SELECT 'region', asked, 2, count(*), sum(r_regionkey)::bigint, max(r_name) FROM region, m GROUP BY asked""",
)
def explorer_bundle(t):
    """A bundle of tables at one time, read back from its JSON."""
    rows = dumps.bundle({"nation": t("nation"), "region": t("region"), "orders": t("orders")}, span(t))
    names = {"nation": ("n_nationkey", "n_name"), "orders": ("o_orderkey", "o_orderpriority"), "region": ("r_regionkey", "r_name")}
    pick = lambda i: F.coalesce(*(F.when(F.col("table") == k, F.get_json_object("row", f"$.{v[i]}")) for k, v in names.items()))
    fields = F.size(F.from_json("schema", "fields array<struct<name:string>>")["fields"])
    read = rows.select("table", "snapshot", fields.cast("int").alias("fields"), pick(0).cast("long").alias("key"), pick(1).alias("label"))
    return read.groupBy("table", "snapshot", "fields").agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.max("label").alias("top"))


def _zipf_sql(n: int, theta: float) -> str:
    return f"WITH w AS (SELECT r AS rank, pow(r::DOUBLE, -{theta}::DOUBLE) AS w FROM range(1, {n + 1}) t(r)) SELECT rank, round(w / sum(w) OVER (), 9) AS weight FROM w"


@register("zipf_weights", "Z-ZIPF", _zipf_sql(1000, 0.99))
def zipf_weights(t):
    return g.zipf(t.spark, 1000, 0.99).select("rank", F.round("weight", 9).alias("weight"))


def _fnv_sql(value: str) -> str:
    h = f"{g.FNV_BASIS}::HUGEINT"
    steps = [f"h0 AS (SELECT rank, {h} AS h FROM r)"]
    for i in range(8):
        octet = f"(({value}) >> {8 * i}) & 255"
        steps.append(f"h{i + 1} AS (SELECT rank, ((h - h % 256 + xor((h % 256)::bigint, {octet})::HUGEINT) * {g.FNV_PRIME}::HUGEINT) % 18446744073709551616::HUGEINT AS h FROM h{i})")
    return ", ".join(steps)


@register("zipf_scrambled_keys", "Z-ZIPF", "WITH r AS (SELECT r AS rank FROM range(1, 2001) t(r)), " + _fnv_sql("rank") + " SELECT rank, (1 + h % 5000)::bigint AS key, greatest(7000 - (rank - 1), 1)::bigint AS latest FROM h8")
def zipf_scrambled_keys(t):
    """Keys of ranks, scattered by their hash, or counted back from the newest."""
    r = t.spark.range(1, 2001).select(F.col("id").alias("rank"))
    return r.select("rank", g.scrambled(F.col("rank"), 5000).alias("key"), g.latest(F.col("rank"), F.lit(7000).cast("long")).alias("latest"))


_DRAW = "(event_id * 7919 % 1000) / 1000.0::DOUBLE"


@register("workload_mix", "Y-A Y-B Y-C Y-D Y-E Y-F T-MIX", " UNION ALL ".join(f"SELECT '{m}' AS mix, CASE {' '.join(f'WHEN d < {sum(list(s.values())[: i + 1])} THEN {chr(39)}{o}{chr(39)}' for i, o in enumerate(s))} ELSE '{list(s)[-1]}' END AS op, count(*) AS n FROM (SELECT {_DRAW} AS d FROM events) GROUP BY 1, 2" for m, s in g.MIXES.items()))
def workload_mix(t):
    """Operations of the six key-value workloads over one sequence of draws."""
    draw = (F.col("event_id") * 7919 % 1000) / 1000.0
    ops = F.array(*(F.struct(F.lit(m).alias("mix"), g.operation(m, draw).alias("op")) for m in g.MIXES))
    return t("events").select(F.explode(ops).alias("x")).groupBy("x.mix", "x.op").agg(F.count("*").alias("n"))


@register("arrival_keys", "GEN-06 ST-01", "SELECT event_id, greatest(1, event_id - event_id * 31 % 50) AS key FROM events")
def arrival_keys(t):
    i = F.col("event_id")
    return t("events").select("event_id", g.arrival_key(i, i * 31 % 50).alias("key"))


_NATIONS = ", ".join(f"({i}::bigint, '{n}', {r}::bigint, '{g.REGIONS[r]}')" for i, (n, r) in enumerate(g.NATIONS))


HOT_WINDOW, HOT_THETA = 20, 0.99
_TOPS = f"tops AS (SELECT sum(pow(r::DOUBLE, -{HOT_THETA}::DOUBLE)) OVER (ORDER BY r) / sum(pow(r::DOUBLE, -{HOT_THETA}::DOUBLE)) OVER () AS top, r FROM range(1, {HOT_WINDOW + 1}) t(r))"
HOT_SQL = f"""{_TOPS}, drawn AS (SELECT event_id, user_id, event_type, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS d, (event_id * 104729 % 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS h FROM events),
tail AS (SELECT event_id, user_id, event_type, CASE WHEN d < 0.2 THEN 'arrival' ELSE 'hot_update' END AS op,
  CASE WHEN d < 0.2 THEN greatest(1, event_id + 1 - event_id * 31 % 50) ELSE greatest(1, event_id + 1 - (SELECT count(*) FROM tops WHERE r < {HOT_WINDOW} AND top <= h)) END AS key FROM drawn)"""


def tail_operations(events):
    """(event_id, user_id, event_type, op, key): arrivals and updates near the tail."""
    i = F.col("event_id")
    op = g.tail_operation((i * 7919 % 1000) / 1000.0)
    hot = g.hot_key((i * 104_729 % 1000 + 0.5) / 1000.0, i + 1, HOT_WINDOW, HOT_THETA)
    return events.select("event_id", "user_id", "event_type", op.alias("op"), F.when(op == "arrival", g.arrival_key(i + 1, i * 31 % 50)).otherwise(hot).alias("key"))


@register("hot_tail_mix", "ST-04 ST-08", f"WITH {HOT_SQL} SELECT event_id, op, key FROM tail")
def hot_tail_mix(t):
    """A fifth of the operations arrive, the others update a key of the newest 20."""
    return tail_operations(t("events")).select("event_id", "op", "key")


@register("fixed_nations", "GEN-02", f"SELECT * FROM (VALUES {_NATIONS}) v(n_id, n_name, n_regionkey, r_name)")
def fixed_nations(t):
    """The fixed nations with their regions."""
    return g.nations(t.spark).join(g.regions(t.spark), F.col("n_regionkey") == F.col("r_id")).select("n_id", "n_name", "n_regionkey", "r_name")


@register("population_counts", "GEN-01 GEN-03", "SELECT * FROM (VALUES ('cust_last_order', 600::bigint), ('customer', 600::bigint), ('customer_name_idx', 600::bigint), ('history', 600::bigint), ('order_lines_not_counted_by_orders', 0::bigint), ('district', 20::bigint), ('item', 100::bigint), ('new_order', 180::bigint), ('nation', 25::bigint), ('orders', 600::bigint), ('region', 5::bigint), ('stock', 200::bigint), ('supplier', 10::bigint), ('warehouse', 2::bigint)) v(name, n)")
def population_counts(t):
    """Rows of a small generated population."""
    tables = g.population(t.spark, warehouses=2, customers=30, items=100, orders=30, suppliers=10)
    out = None
    for name, df in tables.items():
        if name != "order_line":
            one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
            out = one if out is None else out.unionByName(one)
    # The size of order_line is drawn: each order says how many lines it has.
    key = ["w_id", "d_id", "o_id"]
    found = tables["order_line"].groupBy(*key).agg(F.count("*").alias("found"))
    wrong = tables["orders"].join(found, key, "full").where("NOT found <=> o_ol_cnt OR o_ol_cnt NOT BETWEEN 5 AND 15")
    return out.unionByName(wrong.agg(F.count("*").alias("n")).select(F.lit("order_lines_not_counted_by_orders").alias("name"), "n"))


@register("order_dates", "GEN-04", f"SELECT o - 1 AS ordinal, 1700000000000 - {g.HISTORY_MS} + ({g.HISTORY_MS}::HUGEINT * (o - 1) // 2999)::bigint AS at FROM range(1, 3001) t(o)")
def order_dates(t):
    return t.spark.range(3000).select(F.col("id").alias("ordinal"), g.order_date(1_700_000_000_000, F.col("id"), 3000).alias("at"))


@register("usertable", "GEN-05 RD-10", "SELECT 200::bigint AS n, 20000::bigint AS chars, 200::bigint AS alphanumeric, 200::bigint AS different")
def usertable(t):
    return g.usertable(t.spark, 200, 10, 10).agg(F.count("*").alias("n"), F.sum(F.length("row")).cast("long").alias("chars"), F.count_if(F.col("row").rlike("^[0-9A-Za-z]+$")).alias("alphanumeric"), F.count_distinct("row").alias("different"))
