"""What old versions and commit-log entries must be kept, and garbage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: records of a leaf page; logical buckets of keys stand for leaves.
LEAF_RECORDS = 123
#: Dead share that makes a leaf a candidate for compaction, and fill limits.
DEAD_RATIO, UNDERFLOW, STRONG_UNDERFLOW, OVERFLOW = 0.5, 0.4, 0.2, 0.8


def live_snapshots(transactions: DataFrame, now: int) -> DataFrame:
    """(oldest, newest): start times of transactions open at ``now``."""
    is_open = (F.col("ts_start") <= now) & (F.col("ts_end").isNull() | (F.col("ts_end") > now))
    return transactions.where(is_open).agg(F.min("ts_start").alias("oldest"), F.max("ts_start").alias("newest"))


def committed_writer(last_ended: Column, ts_start: Column, invalid: Column) -> Column:
    """The auto-commit test: a valid stamp whose worker has since ended a transaction."""
    return ~invalid & F.coalesce(last_ended > ts_start, F.lit(False))


def pruned_commits(commits: DataFrame, snapshots: list[int], bound: int) -> DataFrame:
    """Commit-log entries that pruning keeps: each worker's last one before
    ``bound`` and all from there on, the newest, and for each active snapshot the
    last one before it.

    Times of snapshots part the clock into intervals.  The last commit of each
    worker in each interval comes from one aggregate; carried over the intervals
    of a worker it gives every snapshot's entry, so there is no join by time."""
    top = F.max("ts_commit")
    newest = commits.groupBy("worker").agg(top.alias("ts_commit"))
    last = commits.where(F.col("ts_commit") < bound).groupBy("worker").agg(top.alias("ts_commit"))
    after = commits.where(F.col("ts_commit") >= bound).select("worker", "ts_commit")
    at = F.array(*(F.lit(x).cast("long") for x in sorted(set(snapshots)))) if snapshots else F.array().cast("array<bigint>")
    part = F.size(F.filter(at, lambda x: x <= F.col("ts_commit")))  # 0 before the first snapshot
    ends = commits.groupBy("worker", part.alias("_part")).agg(top.alias("ts_commit")).where(F.col("_part") < len(set(snapshots)))
    pinned = ends.select("worker", "ts_commit")  # the last entry of an interval is the last before the snapshot that ends it
    return newest.unionByName(last).unionByName(after).unionByName(pinned).distinct()


def retained(timed: DataFrame, oldest: int) -> DataFrame:
    """Versions that survive compaction: no invalid one; every live one; those
    whose deletion is not committed; and of the deleted ones each key's newest,
    if a reader at the oldest snapshot does not see its deletion."""
    kept = F.col("delete_ts").isNull() | F.col("del_commit").isNull()
    newest = F.row_number().over(Window.partitionBy("key", "_dead").orderBy(F.desc("insert_ts")))
    rows = timed.where("NOT insert_invalid").withColumn("_dead", ~kept).withColumn("_n", newest)
    return rows.where(~F.col("_dead") | ((F.col("_n") == 1) & (F.col("del_commit") >= oldest))).drop("_dead", "_n")


def leaf(key: Column | str = "key", records: int = LEAF_RECORDS) -> Column:
    return F.floor((F.col(key) if isinstance(key, str) else key) / records).cast("long")


def garbage(history: DataFrame, records: int = LEAF_RECORDS) -> DataFrame:
    """(leaf, live, dead, dead_ratio): live and dead versions by logical leaf."""
    dead = F.col("insert_invalid") | F.col("delete_ts").isNotNull()
    g = history.groupBy(leaf(records=records).alias("leaf")).agg(F.count_if(~dead).alias("live"), F.count_if(dead).alias("dead"))
    return g.withColumn("dead_ratio", F.when(F.col("live") + F.col("dead") > 0, F.col("dead") / (F.col("live") + F.col("dead"))).otherwise(0.0))


def compaction_candidates(leaves: DataFrame, ratio: float = DEAD_RATIO) -> DataFrame:
    return leaves.where(F.col("dead_ratio") >= ratio)


def fill_class(share: Column) -> Column:
    return F.when(share >= OVERFLOW, "overflow").when(share < STRONG_UNDERFLOW, "strong_underflow").when(share < UNDERFLOW, "underflow").otherwise("ok")


def node_fill(leaves: DataFrame, capacity: int) -> DataFrame:
    """Logical and physical fill of each leaf, its garbage and threshold flags."""
    total = F.col("live") + F.col("dead")
    logical, physical = F.col("live") / F.lit(capacity), total / F.lit(capacity)
    return leaves.select(
        "leaf",
        "live",
        "dead",
        total.alias("records"),
        logical.alias("logical_fill"),
        physical.alias("physical_fill"),
        "dead_ratio",
        fill_class(physical).alias("fill_class"),
        (logical < UNDERFLOW).alias("logical_underflow"),
        (F.col("dead_ratio") >= DEAD_RATIO).alias("garbage_over"),
    )


def node_rows(history: DataFrame, table: str, checkpoint: str, records: int, capacity: int) -> DataFrame:
    """The inspection row of every logical node: the leaves, and a root above them."""
    dead = F.col("insert_invalid") | F.col("delete_ts").isNotNull()
    is_root = F.col("leaf").isNull()
    live_key = F.when(~dead, F.col("key"))
    counts = history.select(leaf(records=records).alias("leaf"), dead.alias("_dead"), live_key.alias("_key"))
    leaves = counts.groupBy("leaf").agg(F.count_if(~F.col("_dead")).alias("live"), F.count_if("_dead").alias("dead"), F.min("_key").alias("min_key"), F.max("_key").alias("max_key"))
    # The root holds a slot for each leaf, all of them live.
    root = leaves.agg(F.lit(None).cast("long").alias("leaf"), F.count("*").alias("live"), F.lit(0).cast("long").alias("dead"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))
    part = lambda share: int(capacity * share)
    weak, low, high, full = part(STRONG_UNDERFLOW), part(UNDERFLOW), part(OVERFLOW), capacity
    live, total = F.col("live"), F.col("live") + F.col("dead")
    short = live < weak
    return leaves.unionByName(root).select(
        F.lit(checkpoint).alias("checkpoint"),
        F.lit(table).alias("table"),
        F.when(is_root, "root").otherwise(F.col("leaf").cast("string")).alias("node_id"),
        F.when(is_root, "").otherwise("root").alias("parent_id"),
        F.when(is_root, 0).otherwise(1).alias("depth"),
        is_root.alias("is_root"),
        F.when(is_root, "internal").otherwise("leaf").alias("node_type"),
        F.lit(capacity).alias("capacity"),
        F.lit(full).alias("overflow_threshold"),
        "live",
        "dead",
        total.alias("total"),
        (live / capacity).alias("logical_fill"),
        (total / capacity).alias("physical_fill"),
        F.when(total > 0, F.col("dead") / total).otherwise(0.0).alias("garbage_ratio"),
        F.lit(weak).alias("weak_d"),
        F.lit(low).alias("strong_min"),
        F.lit(high).alias("strong_max"),
        (live < low).alias("below_strong_min"),
        (live > high).alias("above_strong_max"),
        (~is_root & (live > 0) & short).alias("strict_weak_violation"),
        (~is_root & (live == weak)).alias("at_weak_boundary"),
        (~is_root & short).alias("repair_due"),
        (total >= full).alias("overflow_due"),
        (is_root & (live < 2)).alias("root_collapse_due"),
        F.coalesce(F.col("min_key").cast("string"), F.lit("")).alias("min_key"),
        F.coalesce(F.col("max_key").cast("string"), F.lit("")).alias("max_key"),
    )
