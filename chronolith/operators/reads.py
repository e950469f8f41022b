"""Key-value reads over a snapshot: points, ranges and their terminals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def exists(df: DataFrame, key: str, value) -> bool:
    """Whether the key is there; reads the key column alone, up to one row."""
    return bool(df.where(F.col(key) == value).select(key).limit(1).count())


def scan(df: DataFrame, key: str, lo, hi) -> DataFrame:
    """The inclusive key range [lo, hi], which reaches the file scan as a filter."""
    return df.where(F.col(key).between(lo, hi))


def count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def fold(df: DataFrame, *aggregates: Column) -> DataFrame:
    """A fold as aggregates: partial on each partition, then merged."""
    return df.agg(*aggregates)


def fold_with(df: DataFrame, init: Callable[[], object], step: Callable, merge: Callable, fan_in: int = 64):
    """A fold by any Python functions, for what no aggregate expresses:
    ``step(state, batch)`` takes Arrow record batches, ``merge(a, b)`` states.

    Each partition gives one state; states are merged ``fan_in`` at a time, so
    neither a task nor the driver ever gets more of them."""

    def states(batches):
        import pickle

        import pyarrow as pa

        state = init()
        for b in batches:
            state = step(state, b)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    def merged(batches):
        import pickle

        import pyarrow as pa

        out = None
        for b in batches:
            for x in b.column(0).to_pylist():
                out = pickle.loads(x) if out is None else merge(out, pickle.loads(x))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["state"])

    import pickle

    n, rows = df.rdd.getNumPartitions(), df.mapInArrow(states, "state binary")
    while n > fan_in:
        n = -(-n // fan_in)
        rows = rows.repartition(n).mapInArrow(merged, "state binary")
    out = init()
    for r in rows.collect():  # fan_in states at most
        out = merge(out, pickle.loads(r.state))
    return out


def visited_until(df: DataFrame, key: str, stop: Column) -> DataFrame:
    """Rows in order of the key up to the first that ``stop`` holds for, with it:
    what a visitor that may end early has seen.  The place of the end is an
    aggregate, and the rows before it a filter; nothing is sorted."""
    end = df.where(stop).agg(F.min(key).alias("_end"))
    return df.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (F.col(key) <= F.col("_end"))).drop("_end")  # one row


def first_by_key(df: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """The row with the smallest key (that passes ``keep``): a top-1 per
    partition, then over partitions, never a full sort."""
    rows = df if keep is None else df.where(keep)
    return rows.orderBy(key).limit(1)


def stream(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time, for visitors that may stop early."""
    return df.toLocalIterator()


def visit_until(df: DataFrame, visit: Callable[[Row], bool]) -> int:
    """Visit rows until ``visit`` returns False; the number of rows visited."""
    n = 0
    for n, row in enumerate(stream(df), 1):
        if not visit(row):
            break
    return n


def matches(df: DataFrame, column: str, op: str, value: str) -> Column:
    """A filter of the inspection tool: ``contains`` ignores case; comparisons
    are numeric if both sides are whole numbers, else by text."""
    c = F.col(column).cast("string")
    if op == "contains":
        return F.lower(c).contains(value.lower())
    number = F.expr(f"try_cast(`{column}` AS bigint)")
    compare = {"eq": "__eq__", "neq": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}[op]
    text = getattr(c, compare)(value)
    if not value.lstrip("-").isdigit():
        return text
    return F.when(number.isNotNull(), getattr(number, compare)(int(value))).otherwise(text)


def byte_sum(column: Column) -> Column:
    """The sum of a value's bytes modulo 256."""
    code = F.hex(column.cast("binary"))
    at = F.sequence(F.lit(1), F.greatest(F.length(code) - 1, F.lit(1)), F.lit(2))
    total = F.aggregate(F.transform(at, lambda i: F.coalesce(F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.pmod(total, F.lit(256).cast("long"))
