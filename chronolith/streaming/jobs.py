"""Streaming forms: arrival upserts, commit-gated replay, tumbling counts.

Each is started on a streaming DataFrame and run to the end of what is there
(``availableNow``); the sink is a folder of Parquet in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes
from ..sources.shared import new_folder, remove


def source(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        # A stream has a folder as its source: the file's own, with all other names left out.
        return reader.option("recursiveFileLookup", True).option("pathGlobFilter", p.getName()).parquet(str(p.getParent()))
    return reader.parquet(path)


def finish(query) -> None:
    """Wait until everything that had arrived is durable in the sink."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def to_parquet(stream: DataFrame, name: str, mode: str = "append") -> str:
    """Append a stream's rows to a folder; the folder's path."""
    spark = stream.sparkSession
    out = new_folder(spark, name)
    finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, f"{name}-log")).outputMode(mode).trigger(availableNow=True).start())
    return out


class Buckets:
    """A table by key that micro-batches change bucket by bucket.

    A batch rewrites only the buckets whose keys it holds, into a folder of its
    own (``data/batch=N/bucket=B``), and then logs which batch holds each bucket
    (``log/N``).  A batch that is logged is skipped when it comes again, and one
    that failed half-way is written anew, so a query that is started again on the
    same folder and checkpoint goes on where the last one stopped."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 32):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _names(self, folder: str) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _logged(self) -> tuple[int, dict[int, int]]:
        """The last batch, and the batch that holds each bucket."""
        done = [int(n) for n in self._names(f"{self.path}/log") if "_SUCCESS" in self._names(f"{self.path}/log/{n}")]
        if not done:
            return -1, {}
        rows = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/log/{max(done)}").collect()  # one for each bucket
        return max(done), {r.bucket: r.batch for r in rows}

    def _read(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(held.items())))

    def read(self) -> DataFrame:
        return self._read(self._logged()[1])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def change(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the buckets of the batch's keys by ``merge(old rows, batch)``."""
        last, held = self._logged()
        if number <= last:
            return
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # as many as buckets
            old = {b: held[b] for b in touched if b in held}
            rows = merge(self._read(old), batch).withColumn("bucket", self.bucket())
            folder = f"{self.path}/data/batch={number}"
            rows.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        finally:
            batch.unpersist()
        made = {int(n.partition("=")[2]) for n in self._names(folder) if n.startswith("bucket=")}
        now = {b: n for b, n in held.items() if b not in old} | {b: number for b in made}
        log = self.spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1)
        log.write.mode("overwrite").parquet(f"{self.path}/log/{number}")
        for b, n in old.items():
            remove(self.spark, f"{self.path}/data/batch={n}/bucket={b}")


def run_batches(stream: DataFrame, name: str, step: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or new_folder(stream.sparkSession, f"{name}-log"))
    finish(writer.outputMode(mode).trigger(availableNow=True).start())


def _bucketed(stream: DataFrame, name: str, schema: str, key: str, merge, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream into a bucketed table at ``path``, or a new one; its checkpoint lies beside it."""
    spark = stream.sparkSession
    path = path or new_folder(spark, name)
    table = Buckets(spark, path, schema, key)
    run_batches(stream, name, lambda batch, number: table.change(batch, number, merge), mode, f"{path}/checkpoint")
    return table.read()


def arrival_upsert(arrivals: DataFrame, schema: str, key: str, order: str, path: str | None = None) -> DataFrame:
    """The table after a stream of arrivals (key, order, payload): an arrival
    with a known key replaces its row, a late one too.  Nothing is dropped."""
    columns = [c.split()[0] for c in schema.split(",")]
    rows = arrivals.select(order, *(c for c in columns if c != order))

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        return changes.upsert(old, batch, key, order).select(*columns)

    return _bucketed(rows, "upsert", schema, key, merge, path=path)


def hot_tail(operations: DataFrame, schema: str, key: str, order: str, path: str | None = None) -> DataFrame:
    """The table after a stream of arrivals and of updates near the tail (column
    ``op``), which change only rows that have arrived."""
    columns = [c.split()[0] for c in schema.split(",")]

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        arrived = old.unionByName(batch.where("op = 'arrival'").select(*columns))
        return changes.hot_upsert(arrived, batch.where("op <> 'arrival'").select(*columns), key, order).select(*columns)

    return _bucketed(operations, "hot-tail", schema, key, merge, path=path)


def tumbling_counts(rows: DataFrame, ts: str, width: str, path: str | None = None) -> DataFrame:
    """(start, n) by tumbling window; rows without a time are counted under a null
    start.  A batch adds its counts to those of the table, which is the state, so
    there is no watermark and no row is too late, in whatever order files come."""

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        return old.unionByName(batch).groupBy("start").agg(F.sum("n").alias("n"))

    spark = rows.sparkSession
    path = path or new_folder(spark, "tumbling")
    table = Buckets(spark, path, "start timestamp, n long", "start")

    def step(batch: DataFrame, number: int) -> None:
        # A window leaves out rows without a time, so these get one for as long as that.
        window = F.window(F.coalesce(ts, F.timestamp_seconds(F.lit(0))), width)["start"]
        starts = batch.select(F.when(F.col(ts).isNotNull(), window).alias("start"))
        table.change(starts.groupBy("start").agg(F.count("*").alias("n")), number, merge)

    run_batches(rows, "tumbling", step, checkpoint=f"{path}/checkpoint")
    return table.read()


def commit_gated(writes: DataFrame, commits: DataFrame, ts: str, within: str, lateness: str) -> str:
    """Writes that got their commit: a stream-stream join on (worker, ts_start),
    with watermarks on both sides and a bound on the time between them, so the
    state of either side is dropped once no partner can come."""
    w = writes.withWatermark(ts, lateness)
    c = commits.select(F.col("worker").alias("cw"), F.col("ts_start").alias("cs"), "ts_commit", F.col(ts).alias("cts")).withWatermark("cts", lateness)
    near = F.col("cts").between(F.col(ts), F.col(ts) + F.expr(f"INTERVAL {within}"))
    joined = w.join(c, (F.col("worker") == F.col("cw")) & (F.col("ts_start") == F.col("cs")) & near).drop("cw", "cs", "cts")
    return to_parquet(joined, "committed")


def stateful_outcomes(ops: DataFrame, key: str = "key", order: str = "seq") -> str:
    """Outcomes of operations as they arrive: per key the state is whether it is
    live and whether it ever was.  Arrivals of a key come in order."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, parts, state):
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(parts)).sort_values("seq")
        op, n = rows["op"].to_numpy(), len(rows)
        live0, ever0 = state.get if state.exists else (False, False)
        # The last insert or delete before each operation decides whether the key is live.
        turn, made = np.isin(op, ("I", "D")), op == "I"
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(turn, np.arange(n), -1))])
        live = np.where(last >= 0, op[last] == "I", live0)
        ever = np.concatenate([[ever0], ever0 | np.maximum.accumulate(made)])
        missing = np.where(ever[:n], "KeyAlreadyDeleted", "KeyDoesNotExist")
        done = np.select([made, op == "U"], [np.where(live[:n], "KeyAlreadyExists", "Inserted"), np.where(live[:n], "Updated", missing)], np.where(live[:n], "Deleted", missing))
        state.update((bool(live[n]), bool(ever[n])))
        yield pd.DataFrame({"key": k[0], "seq": rows["seq"].to_numpy(), "op": op, "outcome": done})

    found = ops.select(F.col(key).alias("key"), F.col(order).alias("seq"), "op").groupBy("key").applyInPandasWithState(step, "key long, seq long, op string, outcome string", "live boolean, ever boolean", "append", GroupStateTimeout.NoTimeout)
    return to_parquet(found, "outcomes")


def hardened(shards: DataFrame, written: str = "written", durable: str = "durable") -> Column:
    """The largest version below which everything is durable, over log shards:
    one less than the smallest version still on its way, or the largest written."""
    pending = F.when(F.col(durable) < F.col(written), F.col(durable) + 1)
    return F.coalesce(F.min(pending) - 1, F.max(written))
