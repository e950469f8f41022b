"""Named queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.shared import stamp, written


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...]  # operators of the survey that it covers


QUERIES: dict[str, Query] = {}
_SCHEMAS: dict[tuple[str, str], StructType] = {}
_STORED: dict[tuple, object] = {}


def register(name: str, ids: str = "", sql: str | None = None):
    """Decorator for a function of a table reader ``t``: ``t("orders")``."""

    def wrap(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(run, sql, tuple(ids.split()))
        return build

    return wrap


@dataclass(frozen=True)
class Tables:
    """Reads a table by name.  A table's schema is read from its files once a
    session; later reads plan without touching them."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        key = (self.spark.sparkContext.applicationId, path)
        known = _SCHEMAS.get(key)
        if known is None:
            df = self.spark.read.parquet(path)
            _SCHEMAS[key] = df.schema
            return df
        return self.spark.read.schema(known).parquet(path)

    def once(self, name: str, source: str, build: Callable[[], object]):
        """What ``build`` gives for the present content of table ``source``;
        built once a session, and again when the table's files change."""
        path = f"{self.folder}/{source}.parquet"
        key = (self.spark.sparkContext.applicationId, path, name)
        now = stamp(self.spark, path)
        held = _STORED.get(key)
        if held is None or held[0] != now:
            held = _STORED[key] = (now, build())
        return held[1]

    def stored(self, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table derived from ``source``, written to the shared folder once."""
        return self.once(name, source, lambda: written(build(), name)[0])


def load() -> dict[str, Query]:
    """All queries; importing a plan module registers what it has."""
    from . import ch, changelog, generated, interfaces, keyspace, metrics, oltp, retained, scans, streamed, versions  # noqa: F401

    return QUERIES
