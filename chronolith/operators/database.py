"""Named tables that share one clock and one commit log, and transactions on them.

A table is a version history in the shared folder.  A batch of operations is
applied as DataFrames: each operation is a transaction of its own that starts
and commits at the next two ticks of the clock.  Interactive transactions read
one snapshot (or a newer one for each statement) with their own writes on top.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from . import changes
from . import history as hist

STAMPS = "key long, insert_worker long, insert_ts long, insert_invalid boolean, delete_worker long, delete_ts long"
COMMITS = "worker long, ts_start long, ts_commit long"


class Database:
    """Tables by name; ids follow the order of creation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.now = spark, 1
        self.tables: dict[str, DataFrame] = {}
        self.commits = spark.createDataFrame([], COMMITS)

    def create(self, name: str, payload: str = "value long") -> int:
        """The table's id; creating it again changes nothing."""
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], f"{STAMPS}, {payload}")
        return list(self.tables).index(name)

    def payload(self, name: str) -> list[str]:
        return self.tables[name].columns[6:]

    def apply(self, name: str, ops: DataFrame, worker: int = 0) -> DataFrame:
        """Apply operations (seq, key, op and payload columns) in order of seq;
        (seq, key, op, outcome).  What the table holds comes in as operations
        before the first, so outcomes need no state but one row per key."""
        old, cols = self.tables[name], self.payload(name)
        # An operation's number is its place on the clock: no sort over all of them.
        start = F.lit(self.now) + 2 * F.col("seq")
        new = ops.select("seq", "key", "op", F.lit(worker).cast("long").alias("worker"), start.alias("ts_start"), (start + 1).alias("ts_commit"), *cols)
        held = old.where("NOT insert_invalid").groupBy("key").agg(F.bool_or(F.col("delete_ts").isNull()).alias("live"))
        blank = [F.lit(None).cast(dict(old.dtypes)[c]).alias(c) for c in cols]
        past = held.select(F.lit(-2).cast("long").alias("seq"), "key", F.lit("I").alias("op"), F.lit(worker).cast("long").alias("worker"), F.lit(-2).cast("long").alias("ts_start"), F.lit(-2).cast("long").alias("ts_commit"), *blank)
        gone = held.where("NOT live").select(F.lit(-1).cast("long").alias("seq"), "key", F.lit("D").alias("op"), F.lit(worker).cast("long").alias("worker"), F.lit(-1).cast("long").alias("ts_start"), F.lit(-1).cast("long").alias("ts_commit"), *blank)
        done, _ = written(changes.outcomes(past.unionByName(gone).unionByName(new)), f"outcomes-{name}")
        mine = done.where("seq >= 0")
        first = mine.where(F.col("outcome").isin("Updated", "Deleted")).groupBy("key").agg(F.min("ts_start").alias("_end"))
        closed = old.join(first, "key", "left").withColumns({"delete_worker": F.when(F.col("delete_ts").isNull() & ~F.col("insert_invalid") & F.col("_end").isNotNull(), F.lit(worker).cast("long")).otherwise(F.col("delete_worker")), "delete_ts": F.when(F.col("delete_ts").isNull() & ~F.col("insert_invalid"), F.col("_end")).otherwise(F.col("delete_ts"))})
        added = changes.versions(mine, payload=cols)
        self.tables[name], _ = written(closed.select(*old.columns).unionByName(added.select(*old.columns)), f"history-{name}")
        effective = mine.where(F.col("outcome").isin(*changes.EFFECTIVE))
        self.commits, _ = written(self.commits.unionByName(effective.select("worker", "ts_start", "ts_commit")), "commits")
        top = mine.agg(F.max("ts_commit")).first()[0]
        self.now = self.now if top is None else top + 1
        return mine.select("seq", "key", "op", "outcome")

    def snapshot(self, name: str, at: int | None = None) -> DataFrame:
        """(key, payload) at a time; a time beyond the clock reads the present."""
        rows = hist.snapshot(self.tables[name], self.commits, self.now if at is None else at)
        return rows.select("key", *self.payload(name))

    def dispatch(self, name: str, kind: str, key: int | None = None, hi: int | None = None, **payload):
        """One operation in a transaction of its own: an outcome for writes, the
        rows for ``point`` and ``range``."""
        if kind == "point":
            return self.snapshot(name).where(F.col("key") == key)
        if kind == "range":
            return self.snapshot(name).where(F.col("key").between(key, hi))
        op = {"insert": "I", "update": "U", "delete": "D"}.get(kind)
        if op is None:
            raise ValueError(f"unsupported operation {kind}")
        types = {f.name: f.dataType for f in self.tables[name].schema.fields}
        row = self.spark.range(1).select(F.lit(0).cast("long").alias("seq"), F.lit(key).cast("long").alias("key"), F.lit(op).alias("op"), *(F.lit(payload.get(c)).cast(types[c]).alias(c) for c in self.payload(name)))
        return self.apply(name, row).first().outcome


@dataclass
class Step:
    """One statement of a transaction: read, scan, insert, update or delete."""

    kind: str
    table: str
    key: int | None = None
    hi: int | None = None
    values: dict = field(default_factory=dict)
    where: Column | None = None


def what_if(db: Database, steps: list[Step], mode: str = "si", at: int | None = None) -> tuple[list[tuple[str, list[Row]]], bool]:
    """Run a transaction's statements without keeping its writes: each one's
    (status, rows), and whether it was aborted.

    ``si`` reads one snapshot, ``rc`` a newer one for each statement, ``ru`` the
    newest version of each key, committed or not.  Own writes lie on top.  The
    first insert of a held key, and the first update or delete of a missing
    one, ends the transaction.  Only rows of asked keys come to the driver."""
    base_ts = db.now if at is None else at
    ticks, out = (1 if mode == "rc" else 0), []
    own: dict[str, dict[int, dict | None]] = {}

    def view(table: str) -> DataFrame:
        cols = ["key", *db.payload(table)]
        if mode == "ru":
            base = hist.physical(db.tables[table]).select(*cols)
        else:
            base = db.snapshot(table, base_ts + ticks if mode == "rc" else base_ts)
        mine = own.get(table)
        if not mine:
            return base
        schema = ", ".join(f"{n} {t}" for n, t in base.dtypes) + ", deleted boolean"
        rows = [(k, *((v or {}).get(c) for c in cols[1:]), v is None) for k, v in mine.items()]
        return changes.overlay(base, db.spark.createDataFrame(rows, schema))

    for s in steps:
        rows = view(s.table)
        if s.kind == "scan":
            found = rows.where(F.col("key").between(s.key, s.hi))
            found = found if s.where is None else found.where(s.where)
            out.append(("matched", found.orderBy("key").collect()))
            continue
        before = rows.where(F.col("key") == s.key).collect()
        if s.kind == "read":
            kept = before if s.where is None or not before else rows.where((F.col("key") == s.key) & s.where).collect()
            out.append(("found" if kept else "filtered" if before else "missing", kept))
            continue
        if s.kind == "insert" and before:
            return [*out, ("conflict", before)], True
        if s.kind in ("update", "delete") and not before:
            return [*out, ("missing", [])], True
        old = before[0].asDict() if before else {"key": s.key}
        new = None if s.kind == "delete" else {**old, **s.values}
        own.setdefault(s.table, {})[s.key] = new
        out.append(({"insert": "inserted", "update": "updated", "delete": "deleted"}[s.kind], before if new is None else [Row(**new)]))
        ticks += mode == "rc"
    return out, False
