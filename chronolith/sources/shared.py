"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local run gets one of its own; a cluster gets an error,
    as no folder of one machine is there for the others."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("chronolith.local.shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.conf.set("chronolith.local.shared", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a table; removed when the driver ends."""
    path = f"{shared_folder(spark)}/chronolith/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells a later content of a table's files from this one: their number,
    bytes and latest change."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.listStatus(p))
    return len(found), sum(x.getLen() for x in found), max((x.getModificationTime() for x in found), default=0)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and an executor that is lost takes no intermediate result with it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return
