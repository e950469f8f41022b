"""Conflicts between transactions: first writer wins, and read committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import asof


def first_writer(writes: DataFrame) -> DataFrame:
    """Adds ``conflict``: at the time of the write (``seq``) another worker's
    newest earlier write of the key was not visible at ``read_ts``.

    Writes have key, worker, seq, ts_start, read_ts, ts_commit (null if never
    committed).  The earlier write that counts is the newest by another worker
    that was not rolled back (one level: it is taken as not in conflict itself),
    and it is visible if its commit lies before the reader's snapshot.  The last
    write of another worker is the last write, or the last one before the
    present worker's run of writes, so one window per key finds it."""
    w = Window.partitionBy("key").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    prev_worker = F.lag("worker").over(w)
    mine = writes.withColumn("_turn", prev_worker.isNull() | (prev_worker != F.col("worker")))
    # The write before a run of one worker's writes is the newest foreign write of the whole run.
    entry = F.when(F.col("_turn"), F.struct(F.lag("ts_commit").over(w).alias("c"), F.lag("worker").over(w).alias("o")))
    found = mine.withColumn("_entry", entry).withColumn("_foreign", F.coalesce("_entry", F.last("_entry", ignorenulls=True).over(before)))
    seen = F.col("_foreign.c").isNotNull() & (F.col("_foreign.c") < F.col("read_ts"))
    return found.withColumn("conflict", F.col("_foreign.o").isNotNull() & ~F.coalesce(seen, F.lit(False))).drop("_turn", "_entry", "_foreign")


def auto_commit(writes: DataFrame) -> DataFrame:
    """Adds ``conflict``: the newest earlier write of the key is of a
    transaction that had not ended yet when this one wrote (at ``ts_write``)."""
    w = Window.partitionBy("key").orderBy("seq")
    end, other = F.lag("ts_end").over(w), F.lag("worker").over(w)
    still = other.isNotNull() & (other != F.col("worker")) & (end.isNull() | (end >= F.col("ts_write")))
    return writes.withColumn("conflict", F.coalesce(still, F.lit(False)))


def serial_winners(writes: DataFrame) -> DataFrame:
    """First writer wins with cascading aborts, for transactions of one key:
    a write that loses is rolled back, so it hinders no later one.

    Each key's writes pass in order through one sorted stream.  Of what was
    written, the fold holds the newest kept write and the newest kept one by a
    different worker: one of them is the newest foreign write of whoever comes."""
    schema = "key long, seq long, worker long, conflict boolean"

    def fold(batches):
        import pyarrow as pa

        at, first, second = (), None, None
        for b in batches:
            keys, seqs, workers, reads, commits = (c.to_pylist() for c in b.columns)
            out = []
            for key, worker, read, commit in zip(keys, workers, reads, commits):
                if at != (key,):
                    at, first, second = (key,), None, None
                foreign = second if first is not None and first[0] == worker else first
                lost = foreign is not None and not (foreign[1] is not None and foreign[1] < read)
                out.append(lost)
                if not lost:
                    if first is not None and first[0] != worker:
                        second = first
                    first = (worker, commit)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(seqs, pa.int64()), pa.array(workers, pa.int64()), pa.array(out, pa.bool_())], ["key", "seq", "worker", "conflict"])

    rows = writes.select("key", "seq", "worker", "read_ts", "ts_commit")
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(fold, schema)


def read_committed(statements: DataFrame, versions: DataFrame, value: str = "value", width: int | None = None) -> DataFrame:
    """Each statement (key, ts) with the value that was committed last before
    its own time, as its read timestamp is renewed for every statement.
    ``width`` cuts hot keys into slices of time."""
    return asof(statements, versions, ["key"], "ts", "ts_commit", [value], strict=True, width=width)
