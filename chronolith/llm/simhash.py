"""Near-duplicate detection by SimHash fingerprints and pigeonhole blocks.

Result of odd inputs: a null or wordless text has fingerprint zero and is
linked like any other; a text of one or two words is one shingle; repeated
shingles count each time; rows with equal ids are kept as they are; rows
without an id link nothing: their component is that of rows with an id and the
same fingerprint, or null; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_batches, ready, spread, written
from .graph import components

BITS = 64
SEED = 42
WIDTH = 3
DISTANCE = 3
#: The largest number of distinct fingerprints that one task holds of one block;
#: larger blocks are dealt out again by finer blocks.
BLOCK_ROWS = 16_384
#: With 16 parts, all but 3 of them fixed, a block has at most 2^12 fingerprints.
FINE_PARTS = 16


def shingles(words: list[bytes], width: int = WIDTH) -> list[bytes]:
    if not words:
        return []
    if len(words) < width:
        return [b" ".join(words)]
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)))]


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text."""
    import numpy as np
    import xxhash

    parts = shingles(text.lower().split(), width)  # bytes: A-Z and the six ASCII spaces only
    n = len(parts)
    if not n:
        return 0
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(x, seed) for x in parts), np.uint64, n)
    at = hashes.view(np.uint8).reshape(n, 8) + (np.arange(8, dtype=np.int64) * 256)
    seen = np.bincount(at.ravel(), minlength=2048).reshape(8, 256)
    ones = seen @ _byte_bits()
    return int(np.packbits((2 * ones > n).ravel(), bitorder="little").view("<u8")[0])


def _byte_bits():
    import numpy as np

    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the signed 64-bit view of each document's fingerprint."""
    ready(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts = b.column(1)
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), width, seed) if t.is_valid else 0 for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, fp long")


def masks(parts: int, distance: int = DISTANCE) -> list[int]:
    """Every choice of ``parts - distance`` of the parts, as signed bit masks.
    Fingerprints within ``distance`` bits agree under one of them at least."""
    cuts = [round(i * BITS / parts) for i in range(parts + 1)]
    part = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    full = [sum(x) for x in combinations(part, parts - distance)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in full]


def parts_for(n: int, distance: int = DISTANCE) -> int:
    """The fewest parts with which random fingerprints meet less often than once each."""
    for parts in range(distance + 1, FINE_PARTS):
        bits = BITS * (parts - distance) / parts
        if n * len(masks(parts, distance)) <= 2 ** (bits + 1):
            return parts
    return FINE_PARTS


def _blocks(fps: DataFrame, parts: int, distance: int) -> DataFrame:
    """Every fingerprint under every mask, sorted by block within its partition."""
    chosen = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(x)).alias("k")) for i, x in enumerate(masks(parts, distance))])
    keyed = fps.select("fp", "root", F.explode(chosen).alias("b")).select("b.m", "b.k", "fp", "root")
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return keyed.repartition(n, "m", "k").sortWithinPartitions("m", "k")


def tree_links(fps, roots, distance: int):
    """Links that connect what lies within ``distance`` bits: one fewer than
    the members of each component, found by widening from one member at a time."""
    import numpy as np

    left_f, left_r, out = fps, roots, []
    while len(left_f) > 1:
        front_f, front_r = [left_f[0]], [left_r[0]]
        left_f, left_r = left_f[1:], left_r[1:]
        while front_f and len(left_f):
            f, r = front_f.pop(), front_r.pop()
            near = np.bitwise_count(left_f ^ f) <= distance
            if near.any():
                out.extend((int(r), int(x)) for x in left_r[near])
                front_f.extend(left_f[near])
                front_r.extend(left_r[near])
                left_f, left_r = left_f[~near], left_r[~near]
    return out


def _links(blocks: DataFrame, distance: int, most: int) -> DataFrame:
    """(a, b, over): links found in blocks; members of blocks of over ``most``
    fingerprints come back as (root, fp, true)."""

    def rows(batches):
        import numpy as np

        held: list[tuple] = []  # the last block's pieces, as it may go on
        held_n, key, over = 0, None, False

        def close():
            if held and not over:
                f, r = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                yield from ((a, b, False) for a, b in tree_links(f, r, distance))

        for b in batches:
            m, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            f, r = b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy()
            if not len(m):
                continue
            new = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.r_[0, new], np.r_[new, len(m)]
            last = len(starts) - 1
            two = (ends - starts == 2) & (np.arange(last + 1) > 0) & (np.arange(last + 1) < last)
            i = starts[two]  # most blocks of several have two: all at once
            near = np.bitwise_count(f[i] ^ f[i + 1]) <= distance
            yield from ((int(x), int(y), False) for x, y in zip(r[i[near]], r[i[near] + 1]))
            for j in np.flatnonzero((ends - starts > 2) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)):
                s, e = starts[j], ends[j]
                if key != (m[s], k[s]):
                    yield from close()
                    held, held_n, key, over = [], 0, (m[s], k[s]), False
                if over or held_n + e - s > most:
                    for x, y in [*held, (f[s:e], r[s:e])]:
                        yield from zip(y.tolist(), x.view(np.int64).tolist(), [True] * len(x))
                    held, held_n, over = [], 0, True
                else:
                    held.append((f[s:e], r[s:e]))
                    held_n += e - s
        yield from close()

    def run(batches):
        import pyarrow as pa

        return in_batches(rows(batches), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("over", pa.bool_())]), 65_536)

    return blocks.mapInArrow(run, "a long, b long, over boolean")


def near_links(fps: DataFrame, distance: int = DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links between roots of distinct fingerprints (columns fp, root)
    that connect exactly what pairs within ``distance`` bits connect.

    A block whose distinct fingerprints exceed ``block_rows`` is dealt out
    again under masks that leave 12 bits free, so no task ever holds more than
    4,096 of them and no pair is lost."""
    found, _ = written(_links(_blocks(fps, parts_for(fps.count(), distance), distance), distance, block_rows), "links")
    links = found.where("NOT over").select("a", "b")
    over = found.where("over").select(F.col("a").alias("root"), F.col("b").alias("fp"))
    if over.limit(1).count():
        over = over.distinct()
        fine = _links(_blocks(over, FINE_PARTS, distance), distance, 1 << BITS)
        links = links.unionByName(fine.select("a", "b"))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that
    links reach).  Equal fingerprints collapse before any join, so a third of
    all rows being copies costs one fingerprint."""
    rows, _ = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct, _ = written(rows.groupBy("fp").agg(F.min("doc_id").alias("root")), "distinct")
    comp = components(near_links(distinct.where("root IS NOT NULL"), distance, block_rows))
    named = distinct.join(comp, distinct.root == comp.node, "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "root").alias("component_id"))
    return rows.join(named, rows.fp == named._fp, "left").select("doc_id", "fp", "component_id")
