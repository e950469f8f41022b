"""Key-value reads on orders and events, and checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reads
from .base import cents
from .registry import register

LO, HI = 100, 199


def _orders(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice").alias("cents"))


@register("point_read", "FLT-01 RD-01 RD-02", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 100")
def point_read(t):
    return reads.point(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 100)


@register("point_exists", "RD-03", "SELECT k AS key, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = k) AS found FROM (VALUES (0::bigint), (77::bigint), (-1::bigint), (99999999::bigint)) v(k)")
def point_exists(t):
    """Existence of asked keys, from the key column alone."""
    asked = t.spark.createDataFrame([(0,), (77,), (-1,), (99_999_999,)], "key long")
    keys = t("orders").where(F.col("o_orderkey").isin(0, 77, -1, 99_999_999)).select(F.col("o_orderkey").alias("k")).distinct()
    return asked.join(keys, F.col("key") == F.col("k"), "left").select("key", F.col("k").isNotNull().alias("found"))


@register("range_scan", "SRC-02 FLT-02 RD-04 RD-05 RD-06 RD-13", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN {LO} AND {HI}")
def range_scan(t):
    return reads.scan(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", LO, HI)


@register("range_count", "RD-10 RD-14", f"SELECT count(*) AS n FROM orders WHERE o_orderkey BETWEEN {LO} AND {HI}")
def range_count(t):
    return reads.count(reads.scan(t("orders"), "o_orderkey", LO, HI))


@register("range_fold_sum", "RD-09 RD-16", f"SELECT CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS bigint)) AS double) / 100 AS total, max(o_custkey) AS top FROM orders WHERE o_orderkey BETWEEN {LO} AND 5000")
def range_fold_sum(t):
    return reads.fold(reads.scan(_orders(t), "o_orderkey", LO, 5000), (F.sum("cents") / 100.0).alias("total"), F.max("o_custkey").alias("top"))


@register("range_min_key", "RD-11 AG-08", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN {LO} AND {HI} ORDER BY o_orderkey LIMIT 1")
def range_min_key(t):
    return reads.first_by_key(reads.scan(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", LO, HI), "o_orderkey")


@register("range_min_where", "RD-12", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey >= {LO} AND o_custkey % 7 = 3 ORDER BY o_orderkey LIMIT 1")
def range_min_where(t):
    return reads.first_by_key(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus").where(F.col("o_orderkey") >= LO), "o_orderkey", F.col("o_custkey") % 7 == 3)


@register("full_count", "SRC-01 RD-07 RD-10 RD-15", "SELECT count(*) AS n FROM lineitem")
def full_count(t):
    return reads.count(t("lineitem"))


@register("zone_pruned_scan", "FLT-08 FLT-10 RD-20", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-07' AND o_custkey > 10")
def zone_pruned_scan(t):
    """The zone predicate reaches the scan, where row-group statistics prune."""
    d = F.col("o_orderdate")
    return t("orders").where(d.between(F.expr("TIMESTAMP_NTZ'1996-03-01'"), F.expr("TIMESTAMP_NTZ'1996-03-07'")) & (F.col("o_custkey") > 10)).select("o_orderkey", "o_orderdate")


@register("checksum_mod256", "AG-07 Y-SCAN", f"SELECT CAST(sum(list_sum(list_transform(range(1, strlen(props) + 1), lambda i: ascii(substr(props, i, 1))))) % 256 AS bigint) AS checksum, count(*) AS n FROM events WHERE event_id BETWEEN {LO} AND 4999")
def checksum_mod256(t):
    """A wrapping 8-bit checksum over a key range, with its count."""
    rows = reads.scan(t("events").select("event_id", "props"), "event_id", LO, 4999)
    return rows.agg(F.pmod(F.sum(reads.byte_sum(F.col("props"))), F.lit(256)).cast("long").alias("checksum"), F.count("*").alias("n"))


@register("snapshot_filters", "FLT-11", "SELECT event_id FROM events WHERE contains(lower(props), lower('K\": 1')) AND user_id >= 9 AND event_type > 'd'")
def snapshot_filters(t):
    """Filters of the inspection tool: text containment without case, whole
    numbers by value, other values by text."""
    rows = t("events")
    for column, op, value in (("props", "contains", 'K": 1'), ("user_id", "gte", "9"), ("event_type", "gt", "d")):
        rows = rows.where(reads.matches(rows, column, op, value))
    return rows.select("event_id")


@register(
    "scan_bounds",
    "S-SCAN ST-05",
    "WITH m AS (SELECT max(event_id) AS top FROM events), b AS (SELECT greatest(1, greatest(1, top - 500) - (2000 - 1)) AS lo, greatest(1, top - 500) AS hi FROM m) SELECT lo, hi, (SELECT count(*) FROM events WHERE event_id BETWEEN lo AND hi) AS n FROM b",
)
def scan_bounds(t):
    """A scan that lags 500 keys behind the tail and spans 2,000."""
    top = t("events").agg(F.max("event_id").alias("top"))
    hi = F.greatest(F.lit(1).cast("long"), F.col("top") - 500)
    bounds = top.select(F.greatest(F.lit(1).cast("long"), hi - 1999).alias("lo"), hi.alias("hi"))
    return t("events").select("event_id").join(F.broadcast(bounds), F.col("event_id").between(F.col("lo"), F.col("hi"))).groupBy("lo", "hi").agg(F.count("*").alias("n"))


@register("fresh_scan_total", "FS", "SELECT sum(n)::bigint AS n FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {x}" for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")) + ")")
def fresh_scan_total(t):
    """Rows over all tables: partial counts, one sum."""
    parts = [t(x).agg(F.count("*").alias("n")) for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.sum("n").alias("n"))
