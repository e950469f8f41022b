"""Mixed-workload analytics: pricing summary, revenue, late orders, revenue by nation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import LINES_SQL, delivered, lines
from .registry import register

CUTOFF, STRICT = "1998-09-02 00:00:00", "2000-01-01 00:00:00"
YEAR = ("1996-01-01 00:00:00", "1997-01-01 00:00:00")
PINNED = ("1999-01-01 00:00:00", "2020-01-01 00:00:00")
HALF = ("1996-01-01 00:00:00", "1996-07-01 00:00:00")
SLACK_DAYS = 30


def ts(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def pricing_summary(rows: DataFrame, where: Column) -> DataFrame:
    """Count, sums and averages by line number of the lines that pass, in order
    of line number.  There are at most 15 groups, so one partition sorts them."""
    money, n = F.sum("cents") / 100.0, F.count("*")
    groups = rows.where(where).groupBy("ol_number").agg(
        n.alias("count_order"),
        F.sum("qty").alias("sum_qty"),
        money.alias("sum_amount"),
        (F.sum("qty") / n).alias("avg_qty"),
        (money / n).alias("avg_amount"),
    )
    return groups.coalesce(1).sortWithinPartitions("ol_number")


_Q1_SQL = "WITH" + LINES_SQL + """
SELECT ol_number, count(*) AS count_order, CAST(sum(qty) AS bigint) AS sum_qty, CAST(sum(cents) AS double) / 100 AS sum_amount,
       CAST(sum(qty) AS double) / count(*) AS avg_qty, CAST(sum(cents) AS double) / 100 / count(*) AS avg_amount
FROM lines WHERE {where} GROUP BY ol_number"""
_REVENUE_SQL = "WITH" + LINES_SQL + " SELECT coalesce(CAST(sum(cents) AS double) / 100, 0.0::DOUBLE) AS revenue FROM lines WHERE {where}"


@register("ch_q1", "Q1 AG-01 AG-02 QD", _Q1_SQL.format(where=f"delivered <= TIMESTAMP '{CUTOFF}'"))
def ch_q1(t):
    """Pricing summary up to and with the cutoff; null dates never pass."""
    return pricing_summary(lines(t), delivered(lambda d: d <= ts(CUTOFF)))


@register("ch_q1_strict", "Q1b", _Q1_SQL.format(where=f"delivered > TIMESTAMP '{STRICT}'"))
def ch_q1_strict(t):
    """The pinned variant: strictly after its date."""
    return pricing_summary(lines(t), delivered(lambda d: d > ts(STRICT)))


@register("ch_q1_in_order", "SO-01", "SELECT row_number() OVER (ORDER BY ol_number) AS place, ol_number, count_order FROM (" + _Q1_SQL.format(where=f"delivered <= TIMESTAMP '{CUTOFF}'") + ")")
def ch_q1_in_order(t):
    """The summary's rows with the places at which they come out."""
    rows = pricing_summary(lines(t), delivered(lambda d: d <= ts(CUTOFF)))
    place = F.monotonically_increasing_id() + 1  # of the one partition, in its order
    return rows.select(place.cast("long").alias("place"), "ol_number", "count_order")


def revenue(rows: DataFrame, where: Column) -> DataFrame:
    """The sum of amounts that pass; zero, not null, if none does."""
    return rows.where(where).agg(F.coalesce(F.sum("cents") / 100.0, F.lit(0.0)).alias("revenue"))


@register("ch_q6", "Q6 AG-03 FLT-08", _REVENUE_SQL.format(where=f"delivered >= TIMESTAMP '{YEAR[0]}' AND delivered < TIMESTAMP '{YEAR[1]}' AND qty < 24"))
def ch_q6(t):
    return revenue(lines(t), delivered(lambda d: (d >= ts(YEAR[0])) & (d < ts(YEAR[1]))) & (F.col("qty") < 24))


@register("ch_q6_pinned", "Q6b", _REVENUE_SQL.format(where=f"delivered >= TIMESTAMP '{PINNED[0]}' AND delivered < TIMESTAMP '{PINNED[1]}' AND qty BETWEEN 1 AND 100000"))
def ch_q6_pinned(t):
    return revenue(lines(t), delivered(lambda d: (d >= ts(PINNED[0])) & (d < ts(PINNED[1]))) & F.col("qty").between(1, 100_000))


@register("ch_q6_empty", "Q6 AG-03", _REVENUE_SQL.format(where="qty < 0"))
def ch_q6_empty(t):
    return revenue(lines(t), F.col("qty") < 0)


def late_orders(orders: DataFrame, rows: DataFrame, lo: str, hi: str, slack_days: int) -> DataFrame:
    """Orders by number of lines, of those entered in [lo, hi) that have a line
    not delivered, or delivered later than the slack allows.  One join and one
    aggregate over the order's key; orders without lines are not late."""
    asked = orders.where((F.col("o_orderdate") >= ts(lo)) & (F.col("o_orderdate") < ts(hi))).select("o_orderkey", (F.col("o_orderdate") + F.expr(f"INTERVAL '{slack_days}' DAY")).alias("due"))
    joined = rows.select("l_orderkey", "delivered").join(asked, F.col("l_orderkey") == F.col("o_orderkey"))
    per = joined.groupBy("o_orderkey").agg(F.count("*").alias("o_ol_cnt"), F.bool_or(F.col("delivered").isNull() | (F.col("delivered") > F.col("due"))).alias("late"))
    return per.where("late").groupBy("o_ol_cnt").agg(F.count("*").alias("order_count"))


@register(
    "ch_q4",
    "Q4 JN-02 JN-04 AG-06",
    "WITH" + LINES_SQL + f""", per AS (SELECT o_orderkey, count(*) AS o_ol_cnt, bool_or(delivered IS NULL OR delivered > o_orderdate + INTERVAL {SLACK_DAYS} DAY) AS late
FROM orders JOIN lines ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '{HALF[0]}' AND o_orderdate < TIMESTAMP '{HALF[1]}' GROUP BY o_orderkey)
SELECT o_ol_cnt, count(*) AS order_count FROM per WHERE late GROUP BY o_ol_cnt""",
)
def ch_q4(t):
    return late_orders(t("orders"), lines(t), *HALF, SLACK_DAYS)


def revenue_by_nation(orders: DataFrame, rows: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame, name: str, lo: str, hi: str) -> DataFrame:
    """Revenue by the supplier's nation in a region, best first, ties by nation.
    Nations and regions are narrowed to the region before anything else; an
    unknown region leaves nothing."""
    where = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region.where(F.col("r_name") == name), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_nationkey", "n_name")
    asked = orders.where((F.col("o_orderdate") >= ts(lo)) & (F.col("o_orderdate") < ts(hi))).select("o_orderkey")
    joined = rows.select("l_orderkey", "l_suppkey", "cents").join(where, F.col("l_suppkey") == F.col("s_suppkey")).join(asked, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("n_nationkey", "n_name").agg((F.sum("cents") / 100.0).alias("revenue")).orderBy(F.desc("revenue"), "n_nationkey").select("n_name", "revenue")


_Q5_SQL = "WITH" + LINES_SQL + f"""
SELECT n_name, CAST(sum(cents) AS double) / 100 AS revenue
FROM orders JOIN lines ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = '{{region}}' AND o_orderdate >= TIMESTAMP '{YEAR[0]}' AND o_orderdate < TIMESTAMP '{YEAR[1]}' GROUP BY n_nationkey, n_name"""


def _q5(t, region: str) -> DataFrame:
    return revenue_by_nation(t("orders"), lines(t), t("supplier"), t("nation"), t("region"), region, *YEAR)


@register("ch_q5_europe", "Q5 JN-01 JN-03 SO-02", _Q5_SQL.format(region="EUROPE"))
def ch_q5_europe(t):
    return _q5(t, "EUROPE")


@register("ch_q5_asia", "Q5", _Q5_SQL.format(region="ASIA"))
def ch_q5_asia(t):
    return _q5(t, "ASIA")


@register("ch_q5_unknown_region", "Q5", _Q5_SQL.format(region="ATLANTIS"))
def ch_q5_unknown_region(t):
    return _q5(t, "ATLANTIS")


@register(
    "q1_path_agreement",
    "QV",
    "WITH" + LINES_SQL + """, s AS (SELECT count(*) AS n_rows, count(delivered) AS n_delivered, CAST(sum(cents) FILTER (WHERE delivered IS NOT NULL) AS double) / 100 AS total FROM lines)
SELECT p.path, s.* FROM s, (VALUES ('filtered'), ('by_group'), ('by_range')) p(path)""",
)
def q1_path_agreement(t):
    """Three plans for the same totals: flat, over groups, over key ranges."""

    def totals(rows, path):
        return rows.agg(F.count("*").alias("n_rows"), F.count("delivered").alias("n_delivered"), (F.sum(F.when(F.col("delivered").isNotNull(), F.col("cents"))) / 100.0).alias("total")).select(F.lit(path).alias("path"), "n_rows", "n_delivered", "total")

    rows = lines(t).select("l_orderkey", "ol_number", "delivered", "cents")
    grouped = rows.groupBy("ol_number").agg(F.count("*").alias("a"), F.count("delivered").alias("b"), F.sum(F.when(F.col("delivered").isNotNull(), F.col("cents"))).alias("c"))
    grouped = grouped.agg(F.sum("a").alias("n_rows"), F.sum("b").alias("n_delivered"), (F.sum("c") / 100.0).alias("total")).select(F.lit("by_group").alias("path"), "n_rows", "n_delivered", "total")
    return totals(rows, "filtered").unionByName(grouped).unionByName(totals(rows.repartitionByRange(8, "l_orderkey"), "by_range"))


@register("q1_range_partitioned", "Q1P AG-04", _Q1_SQL.format(where=f"delivered <= TIMESTAMP '{CUTOFF}'"))
def q1_range_partitioned(t):
    """The summary over explicit key ranges equals the flat one."""
    return pricing_summary(lines(t).where(delivered(lambda d: d <= ts(CUTOFF))).repartitionByRange(5, "l_orderkey"), F.lit(True))


def by_ranges(t, where: Column, n: int = 5) -> DataFrame:
    """Lines that pass, dealt out over explicit ranges of the order's key."""
    return lines(t).where(where).repartitionByRange(n, "l_orderkey")


@register("q1_strict_range_partitioned", "Q1bP", _Q1_SQL.format(where=f"delivered > TIMESTAMP '{STRICT}'"))
def q1_strict_range_partitioned(t):
    return pricing_summary(by_ranges(t, delivered(lambda d: d > ts(STRICT))), F.lit(True))


@register("q6_range_partitioned", "Q6P", _REVENUE_SQL.format(where=f"delivered >= TIMESTAMP '{YEAR[0]}' AND delivered < TIMESTAMP '{YEAR[1]}' AND qty < 24"))
def q6_range_partitioned(t):
    return revenue(by_ranges(t, delivered(lambda d: (d >= ts(YEAR[0])) & (d < ts(YEAR[1]))) & (F.col("qty") < 24)), F.lit(True))


@register("q6_pinned_range_partitioned", "Q6bP", _REVENUE_SQL.format(where=f"delivered >= TIMESTAMP '{PINNED[0]}' AND delivered < TIMESTAMP '{PINNED[1]}' AND qty BETWEEN 1 AND 100000"))
def q6_pinned_range_partitioned(t):
    return revenue(by_ranges(t, delivered(lambda d: (d >= ts(PINNED[0])) & (d < ts(PINNED[1]))) & F.col("qty").between(1, 100_000)), F.lit(True))


@register(
    "htap_date_bounds",
    "QD GEN-04",
    """WITH a AS (SELECT max(l_shipdate) AS anchor FROM lineitem)
SELECT anchor - INTERVAL 15 DAY AS cutoff, anchor - INTERVAL 540 HOUR AS q6_lo, anchor - INTERVAL 15 DAY AS q6_hi FROM a""",
)
def htap_date_bounds(t):
    """Bounds of the mixed workload, 15 and 22.5 days before the newest date."""
    a = t("lineitem").agg(F.max("l_shipdate").alias("a"))
    return a.select((F.col("a") - F.expr("INTERVAL '15' DAY")).alias("cutoff"), (F.col("a") - F.expr("INTERVAL '540' HOUR")).alias("q6_lo"), (F.col("a") - F.expr("INTERVAL '15' DAY")).alias("q6_hi"))
