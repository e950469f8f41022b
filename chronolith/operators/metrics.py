"""Measures of a workload: rates, latencies, interference, tuning choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import percentiles as pc
from .sequence import numbered


def per_second(rows: DataFrame, second: Column) -> DataFrame:
    """(second, n) for every second from 0 to the last one with a row, zero
    where nothing happened."""
    counts = rows.groupBy(second.cast("long").alias("second")).agg(F.count("*").alias("n"))
    every = counts.agg(F.max("second").alias("last")).where("last IS NOT NULL")
    every = every.select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("second"))
    return every.join(counts, "second", "left").select("second", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Half the width, in shares of the rows, of the bracket in which a percentile is
#: sought, the accuracy of the sketch that sets it, and the rows up to which a
#: group is its own bracket.
BRACKET, ACCURACY, SMALL = 0.001, 10_000, 4_000


def exact_percentiles(rows: DataFrame, by: list[str], value: str, asked: dict[str, tuple[str, float]]) -> DataFrame:
    """(by..., n, name...) with exact percentiles: name -> (definition, p), the
    definition one of :data:`~chronolith.functions.percentiles.DEFINITIONS`.

    A sketch with a proven rank error brackets each percentile.  What lies below
    a bracket is counted; of what lies inside, values are counted and ranked.  So
    no task gathers or sorts a group: it sorts the distinct values of a bracket,
    a 450th of its rows.  Nulls do not count."""
    x = F.col(value).cast("double")
    shares = sorted({p for _, p in asked.values()})
    lows, highs = [max(0.0, p - BRACKET) for p in shares], [min(1.0, p + BRACKET) for p in shares]
    points = F.array(*map(F.lit, [*lows, *highs]))
    known = rows.where(x.isNotNull()).select(*by, x.alias("_x"))
    sketch = known.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.percentile_approx("_x", points, ACCURACY).alias("_at")
    )
    whole, k = F.col("n") <= SMALL, len(shares)
    sides = F.array(*(
        F.struct(
            F.lit(i).alias("i"),
            F.when(whole | F.lit(lows[i] == 0.0), F.col("_min")).otherwise(F.col("_at")[i]).alias("lo"),
            F.when(whole | F.lit(highs[i] == 1.0), F.col("_max")).otherwise(F.col("_at")[k + i]).alias("hi"),
        )
        for i in range(k)
    ))
    frame = sketch.select(*(F.col(c).alias(f"_by{j}") for j, c in enumerate(by)), "n", sides.alias("_sides"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{j}")) for j, c in enumerate(by)]
    met = known.join(frame, same) if same else known.crossJoin(frame)  # one row
    met = met.select(*by, "n", "_x", F.explode(F.filter("_sides", lambda s: F.col("_x") <= s["hi"])).alias("s"))
    cell = F.when(F.col("_x") >= F.col("s.lo"), F.col("_x"))
    counts = met.groupBy(*by, "n", F.col("s.i").alias("i"), cell.alias("v")).agg(F.count("*").alias("m"))
    order = Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("m").over(order)).where("v IS NOT NULL")
    out = []
    for name, (definition, p) in asked.items():
        here = F.col("i") == shares.index(p)
        low, high, part = pc.DEFINITIONS[definition](F.col("n"), p)
        at = lambda r: F.max(F.when(here & (F.col("upto") > r) & (F.col("upto") - F.col("m") <= r), F.col("v")))
        pick = at(low) if high is None else at(low) * (1 - F.max(part)) + at(high) * F.max(part)
        out.append(pick.alias(name))
    return ranked.groupBy(*by, "n").agg(*out)


def latency(rows: DataFrame, by: list[str], value: str, definition: str = "nearest") -> DataFrame:
    """(by..., p50, p95, p99, n, mean) of each group."""
    asked = {"p50": (definition, 0.5), "p95": (definition, 0.95), "p99": (definition, 0.99)}
    found = exact_percentiles(rows, by, value, asked)
    mean = rows.groupBy(*by).agg(F.avg(value).alias("mean"))
    return found.join(mean, by).select(*by, *asked, "n", "mean")


def every_nth(rows: DataFrame, by: list[str], order: str, n: int, slice_by: Column) -> DataFrame:
    """Systematic sampling: the first of every ``n`` rows of each group."""
    return numbered(rows, by, order, slice_by, "_r").where(F.col("_r") % n == 1 % n).drop("_r")


def interference(base: Column, mixed: Column) -> Column:
    """Loss against the base in percent, 0.0 where the base is not positive."""
    return F.when(base > 0, (base - mixed) / base * 100.0).otherwise(F.lit(0.0))


def relative_to(rows: DataFrame, by: list[str], axis: str, base, value: str) -> DataFrame:
    """Adds ``relative``: the value over that at ``axis`` = base in its group."""
    ref = F.max(F.when(F.col(axis) == base, F.col(value))).over(Window.partitionBy(*by))
    return rows.withColumn("relative", pc.or_zero(F.col(value), ref))


def age_windows(rows: DataFrame, age: str, value: str, n: int = 12) -> DataFrame:
    """Quantiles in ``n`` equal windows from age 0 to the greatest; the last one
    takes what rounding leaves over."""
    top = rows.agg((F.max(age) + 1).alias("_top"))
    idx = F.least(F.lit(n - 1), F.floor(F.col(age) * n / F.col("_top"))).cast("int")
    placed = rows.select(age, value).crossJoin(F.broadcast(top)).select(idx.alias("window"), value)  # one row
    asked = {"median": ("linear", 0.5), "p25": ("linear", 0.25), "p75": ("linear", 0.75), "p99": ("linear", 0.99)}
    return exact_percentiles(placed, ["window"], value, asked).select("window", *asked, "n")


def counter_deltas(before: DataFrame, after: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """What counters grew by between two readings, never below zero."""
    b = before.select(key, *(F.col(c).alias(f"_{c}") for c in counters))
    return after.join(b, key, "left").select(key, *(F.greatest(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0)), F.lit(0)).alias(c) for c in counters))


def source_shares(deltas: DataFrame) -> DataFrame:
    """Shares of page sources, with the two denominators in use."""
    s = deltas.agg(*(F.sum(c).alias(c) for c in ("reuse", "steal", "fresh")))
    every = F.col("reuse") + F.col("steal") + F.col("fresh")
    return s.select("reuse", "steal", "fresh", pc.or_zero(F.col("steal"), F.col("reuse") + F.col("steal")).alias("steal_of_recycled"), pc.or_zero(F.col("steal"), every).alias("steal_of_all"), pc.or_zero(F.col("fresh"), every).alias("fresh_of_all"))


def counter_summary(rows: DataFrame, counts: list[str], peaks: list[str], version: int) -> DataFrame:
    """Sums of counts and maxima of peaks over rows of one schema version, and
    how many rows were used and refused."""
    good = F.col("schema_version") == version
    sums = [F.sum(F.when(good, F.col(c))).alias(c) for c in counts]
    tops = [F.max(F.when(good, F.col(c))).alias(c) for c in peaks]
    return rows.agg(*sums, *tops, F.count_if(good).alias("used"), F.count_if(~good).alias("refused"))


def counter_faults(rows: DataFrame, key: str, counters: list[str], version: int) -> DataFrame:
    """(fault, n): wrong schema version, repeated shard, negative counter."""
    wrong = rows.agg(F.count_if(F.col("schema_version") != version).alias("n")).select(F.lit("schema_version").alias("fault"), "n")
    again = rows.groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias("n")).select(F.lit("duplicate_shard").alias("fault"), "n")
    bad = F.lit(False)
    for c in counters:
        bad = bad | (F.col(c) < 0)
    negative = rows.agg(F.count_if(bad).alias("n")).select(F.lit("negative").alias("fault"), "n")
    return wrong.unionByName(again).unionByName(negative)


def missing(axes: list[DataFrame], actual: DataFrame, key: list[str]) -> DataFrame:
    """Points of the grid of a few short axes that have no result."""
    grid = axes[0]
    for a in axes[1:]:
        grid = grid.crossJoin(a)  # a plan of experiments: the product of short lists
    return grid.join(actual.select(*key).distinct(), key, "left_anti")


#: Pieces that a group's resamples are dealt out in.
SLICES = 16


def _draws(r: int, n: int):
    """Positions 0 to n-1 that resample r draws: xxhash64(r, j) mod n for j from 1 to n."""
    import numpy as np

    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def mix(x, seed):
        h = (seed + p5 + np.uint64(4)) ^ (x * p1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    seed = mix(np.array([r], np.uint64), np.array([42], np.uint64))
    return mix(np.arange(1, n + 1, dtype=np.uint64), seed).view(np.int64) % n


def median_interval(rows: DataFrame, by: list[str], value: str, resamples: int = 4000, level: float = 0.95) -> DataFrame:
    """A bootstrap interval of each group's median.

    Resample r draws position j of a group of n values as hash(r, j) mod n, so
    reruns agree.  Samples are a group's repeated measurements, one list a
    group; its resamples are dealt out over all tasks."""
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_x"))
    schema = StructType([*g.select(*by).schema.fields, StructField("_m", DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                x, s = b.column("_x")[i].values.to_numpy(zero_copy_only=False), b.column("_s")[i].as_py()
                n, mids = len(x), []
                mid = [(n + 1) // 2 - 1, n // 2]
                for r in range(s + 1, resamples + 1, SLICES):
                    low, high = np.partition(_draws(r, n), mid)[mid] if n else (0, 0)
                    mids.append((x[low] + x[high]) / 2 if n else None)
                keys = b.select(by).take(pa.array([i] * len(mids), pa.int64()))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(mids, pa.float64())], [*by, "_m"])

    slices = g.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).select(*by, "_x", "_s")
    drawn = slices.repartition(SLICES, *by, "_s").mapInArrow(run, schema)
    tail = (1 - level) / 2
    lo, hi = int(tail * (resamples - 1)), -int(-(1 - tail) * (resamples - 1) // 1)
    m = drawn.groupBy(*by).agg(F.array_sort(F.collect_list("_m")).alias("_m"))
    return m.select(*by, F.get("_m", F.lit(lo)).alias("low"), F.get("_m", F.lit(hi)).alias("high"))


def choose_setting(rows: DataFrame) -> DataFrame:
    """(setting, best): the smallest setting within 1 % of the best median whose
    interval meets the best one's and whose latency and memory are at most 5 %
    over it (a guard whose reference is not positive passes); else the best."""
    best = rows.orderBy(F.desc("throughput"), "setting").limit(1).select(F.col("setting").alias("b"), F.col("throughput").alias("bt"), F.col("low").alias("bl"), F.col("high").alias("bh"), F.col("p99").alias("bp"), F.col("rss").alias("br"))
    both = rows.crossJoin(best)  # one row of the best
    guard = lambda c, ref: (F.col(ref) <= 0) | (F.col(c) <= F.col(ref) * 1.05)
    fits = (F.col("throughput") >= 0.99 * F.col("bt")) & (F.col("low") <= F.col("bh")) & (F.col("bl") <= F.col("high")) & guard("p99", "bp") & guard("rss", "br")
    return both.groupBy("b").agg(F.min(F.when(fits, F.col("setting"))).alias("s")).select(F.coalesce("s", "b").alias("setting"), F.col("b").alias("best"))
