"""Workload measures over the event table: values are latencies, types are
operations, users are threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import percentiles as pc
from ..operators import metrics as m
from .base import span
from .registry import register


def _e(t):
    return t("events")


_T = "(epoch(ts) - (SELECT min(epoch(ts)) FROM events)) / 7200"


@register(
    "throughput_per_second",
    "MT-01 ST-06",
    f"WITH c AS (SELECT floor({_T})::bigint AS second, count(*) AS n FROM events GROUP BY 1) SELECT s AS second, coalesce(n, 0)::bigint AS n FROM (SELECT unnest(range(0, (SELECT max(second) + 1 FROM c))) AS s) LEFT JOIN c ON s = second",
)
def throughput_per_second(t):
    """Operations in each interval of the run, with zeros; an interval is two hours here."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = _e(t).agg(F.min(micros).alias("t0"))
    rows = _e(t).select(micros.alias("us")).crossJoin(F.broadcast(first))  # one row
    return m.per_second(rows, F.floor((F.col("us") - F.col("t0")) / F.lit(7_200_000_000)))


_WALL = "(epoch(max(ts)) - epoch(min(ts)))"


@register(
    "throughput_total",
    "MT-02 MT-04",
    f"SELECT CASE WHEN {_WALL} > 0 THEN count(*) / {_WALL} ELSE 0.0 END AS per_second, CASE WHEN {_WALL} > 0 THEN count(*) FILTER (WHERE event_type = 'signup') / ({_WALL} / 60) ELSE 0.0 END AS orders_per_minute, CASE WHEN sum(user_id) > 0 THEN count(*) / CAST(sum(user_id) AS DOUBLE) ELSE 0.0 END AS per_unit FROM events",
)
def throughput_total(t):
    """Operations over the wall time of the run, and new orders (signups) a minute."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    wall = (F.max(us) - F.min(us)) / 1e6
    orders = F.count_if(F.col("event_type") == "signup")
    return _e(t).agg(pc.or_zero(F.count("*"), wall).alias("per_second"), pc.or_zero(orders, wall / 60).alias("orders_per_minute"), pc.or_zero(F.count("*"), F.sum("user_id")).alias("per_unit"))


def _rank_sql(rounding: str) -> str:
    pick = lambda p: f"s[{rounding.format(x=f'{p} * (n - 1)')}::bigint + 1]"
    return f"WITH g AS (SELECT event_type, list_sort(list(value)) AS s, count(value) AS n, avg(value) AS mean FROM events GROUP BY 1) SELECT event_type, {pick(0.5)} AS p50, {pick(0.95)} AS p95, {pick(0.99)} AS p99, n, mean FROM g"


_HALF_EVEN = "CASE WHEN ({x})::DOUBLE - floor({x}) = 0.5 THEN 2 * round(({x}) / 2.0) ELSE round({x}) END"


@register("latency_nearest_rank", "AG-09 MT-06", _rank_sql("round({x})"))
def latency_nearest_rank(t):
    return m.latency(_e(t), ["event_type"], "value")


@register("latency_half_even", "AG-10", _rank_sql(f"({_HALF_EVEN})"))
def latency_half_even(t):
    return m.latency(_e(t), ["event_type"], "value", "nearest_even")


@register("latency_interpolated", "AG-11", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, count(value) AS n, avg(value) AS mean FROM events GROUP BY 1")
def latency_interpolated(t):
    return m.latency(_e(t), ["event_type"], "value", "linear")


@register("median_by_group", "AG-12 AG-14 RA-12", "SELECT event_type, median(value) AS median, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def median_by_group(t):
    ends = _e(t).groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    mid = m.exact_percentiles(_e(t), ["event_type"], "value", {"median": ("linear", 0.5)})
    return mid.join(ends, "event_type").select("event_type", "median", "low", "high")


@register("peak_and_average", "AG-13", "SELECT event_type, max(x) AS peak, avg(x) AS mean, sum(x)::bigint AS total FROM (SELECT event_type, try_cast(CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE user_id::varchar END AS bigint) AS x FROM events) GROUP BY 1")
def peak_and_average(t):
    """Cells that are no numbers are skipped."""
    cell = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    rows = _e(t).select("event_type", cell.alias("c")).withColumn("x", F.expr("try_cast(c AS bigint)"))
    return rows.groupBy("event_type").agg(F.max("x").alias("peak"), F.avg("x").alias("mean"), F.sum("x").alias("total"))


@register("attempt_histogram", "AG-15", "SELECT least(user_id, 63) AS attempts, count(*) AS n FROM events GROUP BY 1")
def attempt_histogram(t):
    return _e(t).groupBy(F.least("user_id", F.lit(63)).alias("attempts")).agg(F.count("*").alias("n"))


@register("sampled_latency", "MT-05", "SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) % 64 = 1")
def sampled_latency(t):
    return m.every_nth(_e(t).select("event_id", "event_type", "value"), ["event_type"], "event_id", 64, F.floor(F.col("event_id") / (1 << 16)))


_BY_USER = "SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS base, count(*) FILTER (WHERE event_type = 'click') AS mixed FROM events GROUP BY 1"


@register("interference_pct", "MT-03 RA-01", f"SELECT user_id, CASE WHEN base > 0 THEN (base - mixed) / base::DOUBLE * 100.0::DOUBLE ELSE 0.0 END::DOUBLE AS loss FROM ({_BY_USER})")
def interference_pct(t):
    """Loss of the mixed run against the base, by thread."""
    e = F.col("event_type")
    g = _e(t).groupBy("user_id").agg(F.count_if(e.isin("click", "view")).alias("base"), F.count_if(e == "click").alias("mixed"))
    return g.select("user_id", m.interference(F.col("base"), F.col("mixed")).alias("loss"))


@register("relative_to_baseline", "RA-02 RA-04", "WITH g AS (SELECT user_id % 5 AS threads, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT g.threads, g.event_type, g.n, CASE WHEN b.n > 0 THEN g.n / b.n::DOUBLE ELSE 0.0 END AS relative FROM g LEFT JOIN g b ON g.threads = b.threads AND b.event_type = 'click'")
def relative_to_baseline(t):
    g = _e(t).groupBy((F.col("user_id") % 5).alias("threads"), "event_type").agg(F.count("*").alias("n"))
    return m.relative_to(g, ["threads"], "event_type", "click", "n")


@register("age_windows_12", "RA-03", "SELECT least(11, floor(event_id * 12 / (SELECT max(event_id) + 1 FROM events)::DOUBLE))::integer AS \"window\", median(value) AS median, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.99) AS p99, count(value) AS n FROM events GROUP BY 1")
def age_windows_12(t):
    """Quantiles by twelfths of the run."""
    return m.age_windows(_e(t), "event_id", "value")


@register("scaling_points", "RA-05", "SELECT u AS terminals, greatest(3, u) AS warehouses, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM (SELECT user_id % 8 + 1 AS u, value FROM events) GROUP BY 1")
def scaling_points(t):
    """Throughput and percentiles by terminals; warehouses grow with them."""
    rows = _e(t).select((F.col("user_id") % 8 + 1).alias("terminals"), "value")
    found = m.exact_percentiles(rows, ["terminals"], "value", {"p50": ("linear", 0.5), "p99": ("linear", 0.99)})
    return found.select("terminals", F.greatest(F.lit(3), F.col("terminals")).alias("warehouses"), "n", "p50", "p99")


@register("operation_row", "RA-06", "SELECT event_type AS operation, count(*) AS n, avg(value) AS mean FROM events WHERE event_type = 'view' GROUP BY 1")
def operation_row(t):
    return _e(t).where("event_type = 'view'").groupBy(F.col("event_type").alias("operation")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@register("window_average", "RA-07", "SELECT user_id % 7 AS w, avg(value) AS mean, sum(user_id * 10)::bigint AS ops FROM events GROUP BY 1")
def window_average(t):
    """Windowed latencies averaged; a count is the sum of rate times window."""
    return _e(t).groupBy((F.col("user_id") % 7).alias("w")).agg(F.avg("value").alias("mean"), F.sum(F.col("user_id") * 10).alias("ops"))


@register("staleness_summary", "MT-07 ST-07", "WITH m AS (SELECT (max(event_id) + 1) * 9 // 10 AS now FROM events) SELECT event_type, avg(greatest(now - event_id, 0)) AS mean, max(greatest(now - event_id, 0)) AS top FROM events, m GROUP BY 1")
def staleness_summary(t):
    s = F.greatest(span(t) * 9 // 10 - F.col("event_id"), F.lit(0))
    return _e(t).groupBy("event_type").agg(F.avg(s).alias("mean"), F.max(s).alias("top"))


_COUNTERS = "SELECT user_id % 16 AS shard, count(*) FILTER (WHERE event_type = 'click') AS reuse, count(*) FILTER (WHERE event_type = 'view') AS steal, count(*) FILTER (WHERE event_type = 'error') AS fresh FROM events WHERE {} GROUP BY 1"
_DELTAS = f"SELECT a.shard, greatest(a.reuse - coalesce(b.reuse, 0), 0) AS reuse, greatest(a.steal - coalesce(b.steal, 0), 0) AS steal, greatest(a.fresh - coalesce(b.fresh, 0), 0) AS fresh FROM ({_COUNTERS.format('event_id % 3 <> 0')}) a LEFT JOIN ({_COUNTERS.format('event_id % 2 = 0')}) b ON a.shard = b.shard"


def _counters(t, where: str):
    e = F.col("event_type")
    return _e(t).where(where).groupBy((F.col("user_id") % 16).alias("shard")).agg(F.count_if(e == "click").alias("reuse"), F.count_if(e == "view").alias("steal"), F.count_if(e == "error").alias("fresh"))


def _deltas(t):
    return m.counter_deltas(_counters(t, "event_id % 2 = 0"), _counters(t, "event_id % 3 <> 0"), "shard", ["reuse", "steal", "fresh"])


@register("counter_deltas", "MT-11", _DELTAS)
def counter_deltas(t):
    return _deltas(t)


@register("gc_source_shares", "MT-12", f"WITH s AS (SELECT sum(reuse)::bigint AS reuse, sum(steal)::bigint AS steal, sum(fresh)::bigint AS fresh FROM ({_DELTAS})) SELECT *, CASE WHEN reuse + steal > 0 THEN steal / (reuse + steal)::DOUBLE ELSE 0.0 END AS steal_of_recycled, CASE WHEN reuse + steal + fresh > 0 THEN steal / (reuse + steal + fresh)::DOUBLE ELSE 0.0 END AS steal_of_all, CASE WHEN reuse + steal + fresh > 0 THEN fresh / (reuse + steal + fresh)::DOUBLE ELSE 0.0 END AS fresh_of_all FROM s")
def gc_source_shares(t):
    return m.source_shares(_deltas(t))


@register("gc_counter_faults", "MT-13", "WITH r AS (SELECT user_id AS shard, event_id % 5 AS schema_version, event_id - 50 AS c FROM events) SELECT 'schema_version' AS fault, count(*) FILTER (WHERE schema_version <> 4) AS n FROM r UNION ALL SELECT 'duplicate_shard', count(*) FROM (SELECT shard FROM r GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'negative', count(*) FILTER (WHERE c < 0) FROM r")
def gc_counter_faults(t):
    rows = _e(t).select(F.col("user_id").alias("shard"), (F.col("event_id") % 5).alias("schema_version"), (F.col("event_id") - 50).alias("c"))
    return m.counter_faults(rows, "shard", ["c"], 4)


@register(
    "gc_counter_summary",
    "RA-16",
    "SELECT sum(user_id) FILTER (WHERE event_id % 5 = 4)::bigint AS reuse, sum(event_id % 11) FILTER (WHERE event_id % 5 = 4)::bigint AS steal, max(event_id) FILTER (WHERE event_id % 5 = 4) AS latency_ns_max, count(*) FILTER (WHERE event_id % 5 = 4) AS used, count(*) FILTER (WHERE event_id % 5 <> 4) AS refused FROM events",
)
def gc_counter_summary(t):
    """Counts are summed and peaks maximised, over rows of the known schema alone."""
    i = F.col("event_id")
    rows = _e(t).select((i % 5).alias("schema_version"), F.col("user_id").alias("reuse"), (i % 11).alias("steal"), i.alias("latency_ns_max"))
    return m.counter_summary(rows, ["reuse", "steal"], ["latency_ns_max"], 4)


@register("missing_points", "RA-08", "SELECT u AS threads, e AS event_type FROM (SELECT DISTINCT user_id AS u FROM events) r, (SELECT DISTINCT event_type AS e FROM events) WHERE (u, e) NOT IN (SELECT (user_id, event_type) FROM events)")
def missing_points(t):
    """Points of the plan without a result."""
    actual = _e(t).select(F.col("user_id").alias("threads"), "event_type")
    kinds = _e(t).select("event_type").distinct()
    return m.missing([_e(t).select(F.col("user_id").alias("threads")).distinct(), kinds], actual, ["threads", "event_type"])


@register("manifest_pivot", "RA-09", "SELECT user_id % 6 AS engine, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS bigint) AS gc_on, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS bigint) AS gc_off FROM events GROUP BY 1")
def manifest_pivot(t):
    """Lines by engine with reclamation on and off side by side."""
    rows = _e(t).where("event_type IN ('click', 'view')").withColumn("engine", F.col("user_id") % 6)
    wide = rows.groupBy("engine").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1)))
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n)
    every = _e(t).select((F.col("user_id") % 6).alias("engine")).distinct()
    return every.join(wide, "engine", "left").select("engine", zero("click", "gc_on"), zero("view", "gc_off"))


@register("scan_row_cleanup", "RA-10", "WITH r AS (SELECT event_id, event_type AS mode, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE (user_id % 3)::varchar END AS delay, event_id / 10.0::DOUBLE AS elapsed FROM events), p AS (SELECT *, try_cast(delay AS DOUBLE) AS d FROM r WHERE mode = 'view') SELECT event_id, CASE WHEN d = 0 THEN elapsed ELSE d END AS age FROM p WHERE d IS NOT NULL")
def scan_row_cleanup(t):
    """Other modes are skipped, malformed rows dropped, a zero delay falls back
    to the elapsed time."""
    delay = F.when(F.col("event_id") % 11 == 0, "x").otherwise((F.col("user_id") % 3).cast("string"))
    rows = _e(t).where("event_type = 'view'").select("event_id", delay.alias("delay"), (F.col("event_id") / 10.0).alias("elapsed")).withColumn("d", F.expr("try_cast(delay AS double)"))
    return rows.where("d IS NOT NULL").select("event_id", F.when(F.col("d") == 0, F.col("elapsed")).otherwise(F.col("d")).alias("age"))


@register("bootstrap_interval", "RA-11")
def bootstrap_interval(t):
    """An interval of each operation's median."""
    return m.median_interval(_e(t), ["event_type"], "value")


_SETTINGS = "SELECT user_id AS setting, avg(value) * 1000 AS throughput, avg(value) * 990 AS low, avg(value) * 1010 AS high, max(value) AS p99, count(*)::DOUBLE AS rss FROM events GROUP BY 1"


@register("setting_selection", "RA-13", f"WITH s AS ({_SETTINGS}), b AS (SELECT * FROM s ORDER BY throughput DESC, setting LIMIT 1) SELECT coalesce(min(s.setting) FILTER (WHERE s.throughput >= 0.99 * b.throughput AND s.low <= b.high AND b.low <= s.high AND (b.p99 <= 0 OR s.p99 <= b.p99 * 1.05) AND (b.rss <= 0 OR s.rss <= b.rss * 1.05)), b.setting) AS setting, b.setting AS best FROM s, b GROUP BY b.setting")
def setting_selection(t):
    v = F.avg("value")
    rows = _e(t).groupBy(F.col("user_id").alias("setting")).agg((v * 1000).alias("throughput"), (v * 990).alias("low"), (v * 1010).alias("high"), F.max("value").alias("p99"), F.count("*").cast("double").alias("rss"))
    return m.choose_setting(rows)


@register("class_split", "RA-14", "WITH mix AS (SELECT * FROM (VALUES ('a', 0.5::DOUBLE), ('b', 0.95::DOUBLE), ('e', 0.0::DOUBLE)) v(name, share)), r AS (SELECT user_id % 4 AS u, substr('abcde', (user_id % 5 + 1)::integer, 1) AS name, try_cast(CASE WHEN user_id % 9 = 0 THEN '?' ELSE (count(*) * 10)::varchar END AS DOUBLE) AS ops FROM events GROUP BY user_id) SELECT r.u, r.name, sum(ops * share) AS reads, sum(ops * (1 - share)) AS writes FROM r LEFT JOIN mix ON r.name = mix.name GROUP BY 1, 2")
def class_split(t):
    """Throughput split into reads and writes by each mix's ratio; cells that
    are no numbers count as missing."""
    mix = t.spark.createDataFrame([("a", 0.5), ("b", 0.95), ("e", 0.0)], "name string, share double")
    g = _e(t).groupBy("user_id").agg(F.count("*").alias("n"))
    cell = F.when(F.col("user_id") % 9 == 0, "?").otherwise((F.col("n") * 10).cast("string"))
    r = g.select((F.col("user_id") % 4).alias("u"), F.substring(F.lit("abcde"), (F.col("user_id") % 5 + 1).cast("int"), F.lit(1)).alias("name"), cell.alias("c")).withColumn("ops", F.expr("try_cast(c AS double)"))
    return r.join(mix, "name", "left").groupBy("u", "name").agg(F.sum(F.col("ops") * F.col("share")).alias("reads"), F.sum(F.col("ops") * (1 - F.col("share"))).alias("writes"))


@register("label_extract", "RA-15", "WITH l AS (SELECT event_id, 'mode=' || event_type || ' skew=0.' || user_id || ' olap_threads=' || user_id % 9 AS label FROM events) SELECT event_id, regexp_extract(label, 'mode=([a-z]+)', 1) AS mode, try_cast(regexp_extract(label, 'skew=([0-9.]+)', 1) AS double) AS skew, try_cast(regexp_extract(label, 'olap_threads=([0-9]+)', 1) AS bigint) AS threads FROM l")
def label_extract(t):
    label = F.concat(F.lit("mode="), F.col("event_type"), F.lit(" skew=0."), F.col("user_id"), F.lit(" olap_threads="), F.col("user_id") % 9)
    rows = _e(t).select("event_id", label.alias("label"))
    return rows.select("event_id", F.regexp_extract("label", "mode=([a-z]+)", 1).alias("mode"), F.expr("try_cast(regexp_extract(label, 'skew=([0-9.]+)', 1) AS double)").alias("skew"), F.expr("try_cast(regexp_extract(label, 'olap_threads=([0-9]+)', 1) AS bigint)").alias("threads"))
