"""Removal of word sequences that occur more than once, by De Bruijn compaction.

The edges of the graph are the token k-mers (``window`` consecutive words) of
all texts; an edge's successors are the k-mers that start one word later.

1. Consecutive k-mers of a text with one minimiser are a path.  Paths that occur
   with equal content more than once are classes; a path whose minimiser occurs
   once is left out before it is shuffled.
2. k-mers of paths that share their minimiser but not their content with another
   path, those where texts part or meet, are looked up one by one.
3. Compaction: aggregates over the occurrences give each repeated path or k-mer
   its distinct predecessors and successors.  Where all occurrences of u go on
   to v, and all of v come from u, the two are joined.  What results, a maximal
   nonbranching path, is the same word sequence wherever its first edge occurs.
4. Verification: each occurrence is a span of source coordinates (document,
   first k-mer, last k-mer).  The words at the coordinates of all spans with one
   first edge are compared, by SHA-256; only spans whose words were found at two
   places at least are removed.  Rolling hashes find candidates and decide nothing.

Result of odd inputs: null and wordless texts have no words; texts with fewer
words than a window keep them all; a row that repeats another in id and text is
another place where its words occur; null ids are documents like others; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import in_batches, ready, spread, written

WINDOW = 35
#: Words of the phrases from which a window's minimiser is chosen.
PHRASE = 8
_NULL_ID = -(1 << 63)
_POWERS: dict[str, list] = {}


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(n: int):
    """Powers of an odd base and of its inverse modulo 2^64."""
    import numpy as np

    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        base = 0x9E3779B97F4A7C15
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            _POWERS[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _sums(x):
    """Prefix sums from which the polynomial hash of any range follows."""
    import numpy as np

    up, _ = _powers(len(x) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)], dtype=np.uint64)])


def _range_hash(sums, start, end):
    return _mix((sums[end] - sums[start]) * _powers(len(sums))[1][start])


def _slide(op, x, width: int):
    """op over each range of ``width`` neighbours, in a logarithmic number of passes."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[:n], x[width - span : width - span + n]) if span < width else x[:n]


class Text:
    """Hashes over the words of one text."""

    def __init__(self, raw: bytes, window: int, phrase: int):
        import numpy as np
        import xxhash

        self.words = raw.split()  # bytes: exactly the six ASCII spaces
        n = len(self.words)
        self.n_windows = max(0, n - window + 1)
        if self.n_windows:
            words = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, n)
            self.sums = _sums(words)
            at = np.arange(n - phrase + 1)
            self.phrases = _range_hash(self.sums, at, at + phrase)
            self.least_at = least = _slide(np.minimum, self.phrases, window - phrase + 1)
            cut = np.flatnonzero(least[1:] != least[:-1]) + 1
            self.first = np.concatenate([np.zeros(1, np.int64), cut])
            self.last = np.concatenate([cut, np.array([len(least)])]) - 1
            self.least = least[self.first].view(np.int64)
        self.window = window

    def minimisers(self):
        """The phrase at every place where it is the least of some window.
        Places, not paths, are counted: a window may repeat within one path."""
        import numpy as np

        width = len(self.phrases) - len(self.least_at) + 1
        edge = np.zeros(width - 1, np.uint64)
        most = _slide(np.maximum, np.concatenate([edge, self.least_at, edge]), width)
        return self.phrases[most == self.phrases].view(np.int64)

    def digests(self, first, last):
        """64 and 32 bits of the words of windows first..last."""
        import numpy as np

        a = _range_hash(self.sums, first, last + self.window)
        size = (last - first).astype(np.uint64)
        if not hasattr(self, "other"):
            self.other = _sums(_mix(np.diff(self.sums) * _powers(len(self.sums))[1][: len(self.words)] + np.uint64(0x632BE59BD9B4E019)))
        b = _range_hash(self.other, first, last + self.window)
        return _mix(a + size).view(np.int64), (_mix(b ^ size) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _each(batches, window: int, phrase: int):
    for b in batches:
        ids, tags = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, t in enumerate(b.column(2)):
            if t.is_valid:
                text = Text(t.as_buffer().to_pybytes(), window, phrase)
                if text.n_windows:
                    yield ids[i], tags[i], text


def _minimisers(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(h, n): minimisers and their places, counted by batches of texts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

        for _, _, text in _each(batches, window, phrase):
            held.append(text.minimisers())
            size += len(held[-1])
            if size >= 200_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "h long, n long")


def _paths(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(id, tag, h, span, c, d, prev, next): every path with its minimiser, its
    coordinates, its digest, and the digests of its neighbours in the text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list[tuple] = []
        size = 0
        names = ["id", "tag", "h", "span", "c", "d", "prev", "next"]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)

        for i, tag, text in _each(batches, window, phrase):
            k = len(text.first)
            c, d = text.digests(text.first, text.last)
            ids, tags = np.full(k, i, np.int64), np.full(k, tag, np.int64)
            held.append((ids, tags, text.least, (text.first << 32) | text.last, c, d, *neighbours(c, text.first, text.last)))
            size += k
            if size >= 50_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "id long, tag long, h long, span long, c long, d int, prev long, next long")


def neighbours(c, first, last, lane=None):
    """Digests before and after each of the edges first..last, where those lie
    next to each other in the text (and in one lane); 0 where nothing does."""
    import numpy as np

    touch = last[:-1] + 1 == first[1:]
    if lane is not None:
        touch &= lane[:-1] == lane[1:]
    end = np.zeros(1, np.int64)
    return np.concatenate([end, np.where(touch, c[:-1], 0)]), np.concatenate([np.where(touch, c[1:], 0), end])


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = [z.compress(t.as_buffer().to_pybytes()) if t.is_valid else None for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["id", "tag", "packed"])

    # Said here, as a join would say it, so that all joins see one plan and share its shuffle.
    return docs.mapInArrow(run, "id long, tag long, packed binary").where("id IS NOT NULL AND tag IS NOT NULL")


#: Bit of a span's coordinates that marks a witness: its k-mers are counted, but not removed by themselves.
_WITNESS = -(1 << 63)


def _edges(joined: DataFrame, window: int, phrase: int) -> DataFrame:
    """(id, tag, witness, at, c, d, prev, next): the single k-mers of the paths
    listed in ``spans``, with their neighbours in the path."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdDecompressor()
        names = ["id", "tag", "witness", "at", "c", "d", "prev", "next"]
        for b in batches:
            ids, tags, spans = (b.column(i).to_pylist() for i in (0, 1, 3))
            for i, t in enumerate(b.column(2)):
                text = Text(z.decompress(t.as_buffer().to_pybytes()), window, phrase)
                span = np.array(spans[i], np.int64)
                x = span & ~_WITNESS
                x = x[x & 0xFFFFFFFF < text.n_windows]  # two texts of one id and tag may differ
                order = np.lexsort((x, span >= 0))
                x, witness = x[order], span[order] < 0
                lo, n = x >> 32, (x & 0xFFFFFFFF) - (x >> 32) + 1
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                witness = np.repeat(witness, n)
                if not len(at):
                    continue
                c, d = text.digests(at, at)
                prev, nxt = neighbours(c, at, at, witness)
                for s in range(0, len(at), 50_000):
                    e = slice(s, s + 50_000)
                    k = len(at[e])
                    columns = (np.full(k, ids[i]), np.full(k, tags[i]), witness[e], at[e].astype(np.int32), c[e], d[e], prev[e], nxt[e])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    schema = "id long, tag long, witness boolean, at int, c long, d int, prev long, next long"
    return joined.select("id", "tag", "packed", "spans").mapInArrow(run, schema)


def _degrees():
    """Whether all occurrences of an edge go on to one other, or come from one."""
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    return one("next").alias("go"), one("prev").alias("come")


def repeated_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(id, tag, witness, first, last, u): the occurrences of all maximal
    nonbranching paths of repeated edges, u being the digest of the first one."""
    known = _minimisers(docs, window, phrase).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    paths, _ = written(_paths(docs, window, phrase).join(known, "h", "left_semi"), "paths")
    at = F.struct("id", "tag", "span")
    classes = paths.groupBy("c", "d").agg(F.count("*").alias("n"), F.min(at).alias("one"), F.first("h").alias("h"), *_degrees())
    classes, _ = written(classes, "classes")
    # Where a minimiser also has a path of its own content, one occurrence of each repeated path is looked up by k-mers as well.
    alone = classes.where("n = 1").select("h").distinct().withColumn("mixed", F.lit(True))
    again = classes.where("n > 1").join(alone, "h", "left")
    again = again.select("c", "d", "go", "come", F.lit(True).alias("again"), F.when(F.col("mixed"), F.col("one")).alias("one"))
    look = F.when(F.col("again").isNull(), F.col("span")).when(F.col("one") == at, F.col("span").bitwiseOR(F.lit(_WITNESS)))
    marked = paths.join(again, ["c", "d"], "left").select("id", "tag", "span", "c", "again", "go", "come", look.alias("look"))
    marked, _ = written(marked, "marked")
    some = marked.where("look IS NOT NULL").groupBy("id", "tag").agg(F.collect_set("look").alias("spans"))
    edges, _ = written(_edges(_packed(docs).join(some, ["id", "tag"]), window, phrase), "edges")
    twice = edges.groupBy("c", "d").agg(F.count("*").alias("n"), *_degrees()).where("n > 1").drop("n")
    twice, _ = written(twice, "repeated")  # so the join deals both sides itself, and can split a hot k-mer's
    single = edges.join(twice, ["c", "d"]).select("id", "tag", "witness", F.col("at").alias("first"), F.col("at").alias("last"), "c", "go", "come")
    first, last = F.shiftright("span", 32).cast("int"), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    whole = marked.where("again").select("id", "tag", F.lit(False).alias("witness"), first.alias("first"), last.alias("last"), "c", "go", "come")
    return _compacted(whole.unionByName(single))


def _compacted(edges: DataFrame) -> DataFrame:
    """Neighbouring edges of a text joined along unique successors.

    Frames are ranges of coordinates, so a row that comes twice changes nothing."""
    order = Window.partitionBy("id", "tag", "witness").orderBy("first")
    before = order.rangeBetween(Window.unboundedPreceding, -1)
    mark = F.col("last").cast("long") * 2 + F.col("go").cast("long")  # last grows with first
    prev = F.max(mark).over(before)
    joined = F.coalesce((prev == (F.col("first").cast("long") - 1) * 2 + 1) & F.col("come"), F.lit(False))
    rows = edges.select("*", F.when(~joined, F.col("first")).alias("start"))
    head = F.max("start").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    runs = rows.withColumn("head", head).groupBy("id", "tag", "witness", "head")
    return runs.agg(F.max("last").alias("last"), F.min_by("c", "first").alias("u")).withColumnRenamed("head", "first")


def _words(joined: DataFrame, window: int) -> DataFrame:
    """(u, text): the SHA-256 of the words at the coordinates of every span."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in batches:
            u, out = [], []
            for t, spans in zip(b.column(0), b.column(1)):
                words = z.decompress(t.as_buffer().to_pybytes()).split()
                first, last, who = (spans.values.field(i).to_pylist() for i in range(3))
                for x, y, i in zip(first, last, who):
                    if y + window <= len(words):
                        u.append(i)
                        out.append(hashlib.sha256(b" ".join(words[x : y + window])).digest())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(out, pa.binary())], ["u", "text"])

    return joined.select("packed", "spans").mapInArrow(run, "u long, text binary")


#: Another value for each first edge, so that a join deals both of its sides out anew and can split a hot one.
_DEALT = 0x5DEECE66D


def verified(spans: DataFrame, packed: DataFrame, window: int) -> DataFrame:
    """(v, texts): for each first edge, by v, of whose spans some have the same
    words, a null if all of them have, or else the SHA-256 of each word sequence
    that occurs twice."""
    at = F.struct("first", "last", "u")
    listed = spans.groupBy("id", "tag").agg(F.collect_set(at).alias("spans"))
    found = _words(packed.join(listed, ["id", "tag"]), window).groupBy("u", "text").agg(F.count("*").alias("n"))
    good = F.when(F.col("n") > 1, F.col("text"))
    each = found.groupBy("u").agg(F.count("*").alias("kinds"), F.collect_list(good).alias("texts"))
    texts = F.when(F.col("kinds") > 1, F.col("texts"))
    return each.where(F.size("texts") > 0).select(F.col("u").bitwiseXOR(F.lit(_DEALT)).alias("v"), texts.alias("texts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that
    stay, joined by one space)."""
    ready(docs.sparkSession)
    phrase = min(phrase, window)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id")
    rows = docs.select(key, F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("string").alias("text"))
    rows = spread(rows)
    spans, _ = written(repeated_spans(rows, window, phrase), "spans")
    packed = _packed(rows)
    sound = verified(spans, packed, window)
    own = spans.where("NOT witness").withColumn("v", F.col("u").bitwiseXOR(F.lit(_DEALT))).join(sound, "v")
    found = own.groupBy("id", "tag").agg(F.collect_set(F.struct("first", "last", "texts")).alias("ranges"))

    def rows_of(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in batches:
            ids, ranges = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, t in enumerate(b.column(1)):
                words = z.decompress(t.as_buffer().to_pybytes()).split() if t.is_valid else []
                kept = uncovered(words, ranges[i], window) if ranges[i] else words
                yield None if ids[i] == _NULL_ID else ids[i], len(words), len(words) - len(kept), b" ".join(kept)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        return in_batches(((i, n, m, k.decode()) for i, n, m, k in rows_of(batches)), schema, 500, weigh=lambda r: len(r[3]))

    joined = packed.join(found, ["id", "tag"], "left").select("id", "packed", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def uncovered(words: list[bytes], ranges: list[dict], window: int) -> list[bytes]:
    """The words that no window of a range first..last covers.  A range with
    texts counts if its words are among those."""
    import hashlib

    import numpy as np

    step = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        a, z = r["first"], r["last"] + window
        if z > len(words):
            continue
        if r["texts"] is not None and hashlib.sha256(b" ".join(words[a:z])).digest() not in r["texts"]:
            continue
        step[a] += 1
        step[z] -= 1
    return [w for w, inside in zip(words, np.cumsum(step[:-1]).tolist()) if not inside]
