"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_folder, written  # noqa: F401

#: The six ASCII white-space characters, [\x20\x09-\x0D], that part words.
SPACES = " \t\n\x0b\x0c\r"
#: Java / DuckDB regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of an Arrow batch that a Python worker gets at once, and that it gives.
BATCH_BYTES, OUT_BYTES = 4 << 20, 1 << 20


def ready(spark: SparkSession) -> None:
    """Prepare a session for operators that run Python.

    Workers get batches of bounded bytes, however long the texts are, and give
    freed memory back.  They can import this package even when the driver runs
    outside the repository's folder (on a cluster ship it with ``--py-files``)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    env.setdefault("MALLOC_TRIM_THRESHOLD_", "1000000")
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal_space(c: Column) -> Column:
    """The text without any of the six white-space characters."""
    return F.translate(c, SPACES, "")


def in_batches(rows: Iterable[tuple], schema, size: int = 4096, weigh=None) -> Iterator:
    """Arrow record batches of at most ``size`` rows from an iterator of tuples,
    and of OUT_BYTES where ``weigh`` gives the bytes of a row (or of one row more)."""
    import pyarrow as pa

    held: list[tuple] = []
    weight = 0
    for r in rows:
        held.append(r)
        weight += weigh(r) if weigh else 0
        if len(held) >= size or weight >= OUT_BYTES:
            yield _batch(held, schema, pa)
            held, weight = [], 0
    if held:
        yield _batch(held, schema, pa)


def _batch(rows, schema, pa):
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


#: Inputs of at most so many bytes are dealt out anew before Python work.
SMALL_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input out over all cores: a file with one row group is
    otherwise one task's, and what Python does with it one core's.  Larger
    inputs have row groups enough and are not shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if size <= SMALL_BYTES and n > 1 else df
