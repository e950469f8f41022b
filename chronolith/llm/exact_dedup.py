"""Exact deduplication by an extendible-hash index on shared files.

The 64-bit key of a text is the hash of the text without white space.  A
directory over the leading key bits doubles, and splits the bucket, for as long
as a bucket is overfull.  Each bucket is a key range with one owner task, which
reads its entries in key order, chains entries of one key and compares their
bytes.  Owners write the index entries to the shared folder, next to the
directory, and every document looks its class up there.

Result of odd inputs: a null text counts as empty, so null, empty and
white-space-only texts form one class; a null id loses ties against any other;
of rows with one id only those as long as the row that stays are kept; rows that
agree in text, length and id are all marked as kept and all counted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BATCH_BYTES, normal_space, ready, written

#: Entries that a bucket holds before it splits.
BUCKET_ROWS = 1024
#: The directory has at most 2^MAX_DEPTH slots (8 bytes each); fuller buckets
#: then only grow, as owners stream them.
MAX_DEPTH = 20
#: Bytes of distinct texts that a task holds while it collapses copies.
HELD_BYTES = 16 << 20


class Directory:
    """An extendible-hash directory over the leading bits of unsigned keys."""

    def __init__(self, capacity: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH):
        self.capacity, self.max_depth = capacity, max_depth
        self.depth = 0  # global
        self.slots = [0]  # bucket of each slot
        self.local = {0: 0}  # local depth of each bucket
        self.first = {0: 0}  # its first slot

    def double(self) -> None:
        self.slots = [b for b in self.slots for _ in (0, 1)]
        self.first = {b: 2 * s for b, s in self.first.items()}
        self.depth += 1

    def split(self, bucket: int) -> tuple[int, int]:
        if self.local[bucket] == self.depth:
            self.double()
        self.local[bucket] += 1
        new, width = len(self.local), 1 << (self.depth - self.local[bucket])
        start = self.first[bucket] + width
        self.local[new], self.first[new] = self.local[bucket], start
        self.slots[start : start + width] = [new] * width
        return bucket, new

    def fill(self, counts: dict[int, int], bits: int) -> Directory:
        """Split until no bucket is overfull; counts: entries by the leading ``bits``."""
        total = [0]
        for i in range(1 << bits):
            total.append(total[-1] + counts.get(i, 0))
        todo = [0]
        while todo:
            b = todo.pop()
            d = self.local[b]
            lo = (self.first[b] << (bits - self.depth)) if bits >= self.depth else 0
            if d < min(bits, self.max_depth) and total[lo + (1 << (bits - d))] - total[lo] > self.capacity:
                todo.extend(self.split(b))
        return self


def _better(n: int, key, best: list) -> None:
    """Add n copies whose best row is key = (code points, id)."""
    best[0] += n
    if (-key[0], key[1] is None, key[1]) < (-best[1], best[2] is None, best[2]):
        best[1:] = key


def _out(rows: list, schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _collapse(batches):
    """One row for each distinct text of a task, or of its last HELD_BYTES."""
    import pyarrow as pa

    schema = pa.schema([("h", pa.int64()), ("norm", pa.binary()), ("n", pa.int64()), ("chars", pa.int64()), ("keep_id", pa.int64())])
    seen: dict[bytes, list] = {}
    held = 0

    def flush():
        rows, size = [], 0
        for text, (n, chars, keep, h) in ((t, (*v[:3], v[3])) for t, v in seen.items()):
            rows.append((h, text, n, chars, keep))
            size += len(text)
            if size >= BATCH_BYTES:
                yield _out(rows, schema)
                rows, size = [], 0
        if rows:
            yield _out(rows, schema)

    for b in batches:
        ids, chars, hs = (b.column(i).to_pylist() for i in (0, 1, 2))
        for i, t in enumerate(b.column(3)):
            text = t.as_buffer().to_pybytes()
            best = seen.get(text)
            if best is None:
                seen[text] = [1, chars[i], ids[i], hs[i]]
                held += len(text)
            else:
                key = best[:3]
                _better(1, (chars[i], ids[i]), key)
                best[:3] = key
        if held > HELD_BYTES:
            yield from flush()
            seen, held = {}, 0
    yield from flush()


def _own(batches):
    """Entries in order of bucket and key: one index row for each chain link."""
    import hashlib

    import pyarrow as pa

    schema = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("chain", pa.int32()), ("sha", pa.string()), ("group_size", pa.int64()), ("keep_id", pa.int64()), ("keep_chars", pa.int64())])
    at, chain, rows = None, [], []  # chain: [text, [n, chars, id]] of the present key

    def close():
        rows.extend((*at, i, hashlib.sha256(text).hexdigest(), best[0], best[2], best[1]) for i, (text, best) in enumerate(chain))

    for b in batches:
        buckets, hs, ns, chars, keeps = (b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
        for i, t in enumerate(b.column(2)):
            if at != (buckets[i], hs[i]):
                if chain:
                    close()
                at, chain = (buckets[i], hs[i]), []
            text = t.as_buffer().to_pybytes()
            for known, best in chain:
                if known == text:
                    _better(ns[i], (chars[i], keeps[i]), best)
                    break
            else:
                chain.append((text, [ns[i], chars[i], keeps[i]]))
        if rows:
            yield _out(rows, schema)
            rows.clear()
    if chain:
        close()
        yield _out(rows, schema)


def build_index(docs: DataFrame, id_col: str, text_col: str, bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """The index (bucket, h, chain, sha, group_size, keep_id, keep_chars) and the directory
    (slot, bucket, local_depth), both on shared files."""
    spark = docs.sparkSession
    ready(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"), normal_space(text).alias("norm"))
    rows = rows.select("doc_id", "chars", F.xxhash64("norm").alias("h"), "norm")
    bits = min(max_depth, max(1, math.ceil(math.log2(max(1, docs.count() / bucket_rows))) + 3))
    slot = F.shiftrightunsigned("h", 64 - bits)
    counts = {r.s: r.n for r in rows.groupBy(slot.alias("s")).agg(F.count("*").alias("n")).collect()}  # 2^bits at most
    made = Directory(bucket_rows, max_depth).fill(counts, bits)
    slots = spark.createDataFrame([(i, b, made.local[b]) for i, b in enumerate(made.slots)], "slot long, bucket int, local_depth int")
    directory, _ = written(slots, "directory")

    entries = rows.mapInArrow(_collapse, "h long, norm binary, n long, chars long, keep_id long")
    by_slot = F.shiftrightunsigned("h", 64 - made.depth) if made.depth else F.lit(0).cast("long")
    placed = entries.withColumn("slot", by_slot).join(F.broadcast(directory.select("slot", "bucket")), "slot")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    owned = placed.select("bucket", "h", "norm", "n", "chars", "keep_id").repartition(tasks, "bucket").sortWithinPartitions("bucket", "h")
    index, _ = written(owned.mapInArrow(_own, "bucket int, h long, chain int, sha string, group_size long, keep_id long, keep_chars long"), "index")
    return index, directory


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after white space is deleted; the longest
    original (in code points), then the smallest id, stays."""
    index, _ = build_index(docs, id_col, text_col, bucket_rows, max_depth)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"), normal_space(text).alias("norm"))
    keys = rows.select("doc_id", "chars", F.xxhash64("norm").alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    found = keys.join(index.select("h", "sha", "keep_id", "keep_chars", "group_size"), ["h", "sha"], "left")
    kept = F.expr("doc_id <=> keep_id AND chars = keep_chars").alias("kept")
    return found.select("doc_id", "keep_id", "group_size", kept, F.col("sha").alias("text_sha256"))
