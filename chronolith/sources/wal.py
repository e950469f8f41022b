"""Binary write-ahead logs: encoding, framing, and reading with resynchronisation.

A frame is [length u32][body][crc32 u32], all little-endian.  A body is
[tag][ts_start u64][worker u16] and then [key u64][payload] for a write or
[ts_commit u64] for a commit; in a log of several tables each body starts with
its table id as u32.  Damaged bytes are skipped until a frame fits again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: tags, and the table id of commit markers.
TAGS = {"I": 0, "U": 1, "D": 2, "C": 3}
COMMIT_TABLE = 0xFFFFFFFF
#: Shards of a log by worker; records of a batch that is written at once.
SHARDS, BATCH = 4, 64
_OPS = {v: k for k, v in TAGS.items()}
SCHEMA = "segment string, pos long, table_id long, op string, worker long, ts_start long, key long, payload long, ts_commit long"


def body(table_id: int, op: str, worker: int, ts_start: int, key: int | None, payload: int | None, ts_commit: int | None) -> bytes:
    head = struct.pack("<IBQH", COMMIT_TABLE if op == "C" else table_id, TAGS[op], ts_start, worker)
    if op == "C":
        return head + struct.pack("<Q", ts_commit)
    return head + struct.pack("<Q", key) + (b"" if op == "D" else struct.pack("<Q", payload))


def frame(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data + struct.pack("<I", zlib.crc32(data))


def parse(data: bytes) -> tuple | None:
    """(table_id, op, worker, ts_start, key, payload, ts_commit), or None if it does not fit."""
    if len(data) < 23:
        return None
    table, tag, start, worker = struct.unpack_from("<IBQH", data)
    op, rest = _OPS.get(tag), len(data) - 15
    if op is None or rest < (16 if op in "IU" else 8):
        return None
    first = struct.unpack_from("<Q", data, 15)[0]
    if op == "C":
        return None, op, worker, start, None, None, first
    return table, op, worker, start, first, struct.unpack_from("<Q", data, 23)[0] if op != "D" else None, None


def frames(data: bytes) -> Iterator[tuple[int, tuple]]:
    """(position, record) of every frame that fits; other bytes are skipped."""
    pos, n = 0, len(data)
    while pos + 8 <= n:
        size = struct.unpack_from("<I", data, pos)[0]
        end = pos + 8 + size
        if size and end <= n and zlib.crc32(data[pos + 4 : end - 4]) == struct.unpack_from("<I", data, end - 4)[0]:
            record = parse(data[pos + 4 : end - 4])
            if record is not None:
                yield pos, record
                pos = end
                continue
        pos += 1


def encode(log: DataFrame, segment: str = "segment", order: str = "seq") -> DataFrame:
    """(segment, content): one binary log for each segment, in log order.  Log
    columns: table_id, op (I, U, D, C), worker, ts_start, key, payload, ts_commit."""
    rest = ("table_id", "op", "worker", "ts_start", "key", "payload", "ts_commit")
    rows = log.select(F.col(segment).alias("segment"), F.col(order).alias("seq"), *rest)

    def run(table):
        import pyarrow as pa

        parts = table.sort_by([("seq", "ascending")]).select(rest).to_pylist()
        return pa.table({"segment": table.column("segment").slice(0, 1), "content": pa.array([b"".join(frame(body(*r.values())) for r in parts)], pa.binary())})

    kind = dict(rows.dtypes)["segment"]
    return rows.groupBy("segment").applyInArrow(run, f"segment {kind}, content binary")


def decode(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Records of binary logs, with the log's name and each record's position."""

    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(path, pos, *r) for pos, r in frames(data.as_py() or b"")]
                for s in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[s : s + 10_000]), kinds)], names)

    return files.select(F.col(name).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the log files at ``path``: Spark reads the files, so any
    store will do; a log is kept in segments, each of which is one task's."""
    return decode(spark.read.format("binaryFile").load(path))
