"""Byte-level BPE encoding and decoding with a public rank file.

A text is parted by the vocabulary's pattern and each match is encoded by
itself.  Distinct matches of a batch are bucketed by length into padded integer
matrices.  In each round every row of a matrix merges its leftmost pair of
minimum rank; ranks of pairs come from a hash table in numpy arrays, and rows
without a pair left to merge are compacted away.  A match of more than
``LONG`` bytes is a row of its own that merges, in one round, as many pairs of
that rank as single merges from the left would take in a row.

Result of odd inputs: null and empty texts have no ids and decode to empty
bytes; null ids decode to empty bytes; an id outside the vocabulary raises an
error; special tokens are never made; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ready, spread

LONG = 64
BATCH_CHARS = 1_000_000
#: Distinct matches whose ids a worker remembers.
REMEMBERED = 200_000
NONE = (1 << 31) - 1


def located(rank_file: str) -> str:
    """The path of a rank file; one that is only named is looked up among the
    public tokenizers of the machine that opens it."""
    if os.path.dirname(rank_file):
        return rank_file
    import public_tokenizers

    return public_tokenizers.path(rank_file)


class Vocabulary:
    """Ranks, single-byte ids, and the hashed table of pairs that merge."""

    def __init__(self, rank_file: str, pattern: str):
        import numpy as np
        import regex

        with open(located(rank_file), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self._table(keys, np.array(merged, np.int32))
        self.known: dict[str, bytes] = {}

    def _table(self, keys, values) -> None:
        """Open addressing with linear probing, filled in vector rounds."""
        import numpy as np

        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.full(1 << bits, NONE, np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = (self._slot(keys[todo]) + step) & self.mask
            free = np.flatnonzero(self.values[at] == NONE)
            slot, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[slot], self.values[slot] = keys[todo[won]], values[todo[won]]
            todo, step = np.delete(todo, won), step + 1
        self.probes = step

    def _slot(self, keys):
        import numpy as np

        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left, right):
        """Rank of every pair, NONE for those that don't merge; -1 is padding."""
        import numpy as np

        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(keys)
        found, out = self.keys[slot], self.values[slot]
        out = np.where(found == keys, out, NONE)
        open_ = np.flatnonzero((found != keys) & (self.values[slot] != NONE) & (left >= 0) & (right >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + step) & self.mask
            found, value = self.keys[at], self.values[at]
            hit = found == keys[open_]
            out[open_[hit]] = value[hit]
            open_ = open_[~hit & (value != NONE)]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        import numpy as np

        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(p) > LONG:
                ids = self.merge_row(self.single[np.frombuffer(p, np.uint8)])
                out[i] = ids.astype("<u4").tobytes()
            elif p:
                buckets.setdefault(max(4, -(-len(p) // 4) * 4), []).append(i)
        for width, at in buckets.items():
            for s in range(0, len(at), 8192):
                part = at[s : s + 8192]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        import numpy as np

        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids = self.single[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)].reshape(n, width)
        ids[np.arange(width) >= size[:, None]] = -1
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        done, live = np.empty((n, width), np.int32), np.arange(n)
        columns = np.arange(width)
        while len(live):
            at = ranks.argmin(1)  # the leftmost of equal ranks
            rows = np.arange(len(live))
            low = ranks[rows, at]
            more = low < NONE
            if not more.all():  # compaction of finished rows
                done[live[~more]] = ids[~more]
                live, ids, ranks, at, low = live[more], ids[more], ranks[more], at[more], low[more]
                rows = rows[: len(live)]
                if not len(live):
                    break
            ids[rows, at] = low
            source = columns + (columns > at[:, None])  # what follows the pair moves up by one
            np.minimum(source, width - 1, out=source)
            ids = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[:, -1] = NONE
            before = np.maximum(at - 1, 0)
            after = np.minimum(at + 1, width - 1)
            new = self.pair_ranks(np.concatenate([ids[rows, before], low]), np.concatenate([low, ids[rows, after]]))
            inside = at > 0
            ranks[rows[inside], before[inside]] = new[: len(live)][inside]
            ranks[rows, at] = new[len(live) :]
        flat, kept = done.astype("<u4").tobytes(), (done >= 0).sum(1)
        return [flat[4 * width * i : 4 * (width * i + k)] for i, k in enumerate(kept.tolist())]

    def merge_row(self, ids):
        """One long row; the same result as single leftmost merges."""
        import numpy as np

        ids = ids.astype(np.int32)
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ids) > 1:
            low = ranks.min()
            if low == NONE:
                break
            at = np.flatnonzero(ranks == low)
            first = np.r_[True, at[1:] != at[:-1] + 1]
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]  # of overlapping pairs the left one goes
            joined = np.r_[False, at[1:] == at[:-1] + 2]
            last = len(ids) - 1
            left = self.pair_ranks(np.where(at > 0, np.where(joined, low, ids[np.maximum(at - 1, 0)]), -1), np.full(len(at), low, np.int32))
            right = self.pair_ranks(np.full(len(at), low, np.int32), np.where(at + 2 <= last, ids[np.minimum(at + 2, last)], -1))
            early = np.flatnonzero((left <= low) | (right <= low))  # a merge that a new pair would overtake ends the round
            if len(early):
                at, joined = at[: early[0] + 1], joined[: early[0] + 1]
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, old = ids[keep], np.r_[ranks, NONE][keep]
            now = at - np.arange(len(at))
            stale = np.unique(np.r_[now - 1, now])
            stale = stale[(stale >= 0) & (stale < len(ids) - 1)]
            ranks = old[:-1]
            ranks[stale] = self.pair_ranks(ids[stale], ids[stale + 1])
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.pattern.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({p for x in parts for p in x if p not in known})
        known.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        return [b"".join([known[p] for p in x]) for x in parts]

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(2)
def vocabulary(rank_file: str, pattern: str) -> Vocabulary:
    return Vocabulary(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each whole text, as little-endian unsigned 32-bit
    integers in one binary.  ``rank_file`` must be readable on every worker."""
    ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        v = vocabulary(rank_file, pattern)
        for b in batches:
            start, size = 0, 0
            texts: list[str] = []
            for i, t in enumerate(b.column(1)):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= BATCH_CHARS or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), pa.array(v.encode(texts), pa.binary())], ["doc_id", "ids"])
                    start, size, texts = i + 1, 0, []

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Adds ``decoded``: the bytes that the ids stand for."""
    ready(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        v = vocabulary(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.decode(x.as_buffer()) if x.is_valid else b"" for x in b.column(1)], pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
