"""Approximate nearest neighbours by inner product: inverted file, product
quantisation of residuals, asymmetric distance tables, exact reranking.

Fitted on a bounded sample, the index holds every vector: its cell, the length
of its residual and the codes of the residual's direction.  A query is compared
with the codes in the cells that lie nearest to it, in blocks of bounded size,
and the best by the tables are scored again on the original vectors in double
precision.  Equal vectors are one entry of the index with its smallest ids, as
only those can be among the nearest; so neither a vector that a third of all
rows share nor a full cell ends in one task.

Result of odd inputs: vectors that are null, empty, zero, or hold a null or
non-finite component take no part, nor do those of another length than the
most frequent one; null ids take no part; rows that repeat id and vector count
once; with fewer candidates than asked for all of them are returned; ties go to
the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ready, written

#: Cells: so many times the square root of the number of vectors, at most.  The
#: bound is that of what is fitted on the driver and sent to every worker.
FINENESS, MOST_CELLS = 4, 16_384
#: Vectors that the centroids and codebooks are fitted on: so many a cell, within these bounds.
A_CELL, SAMPLE = 8, (32_768, 131_072)
#: Cells that a query visits: as many as bring this share of the sample's own
#: nearest neighbours in reach.
RECALL = 0.95
#: Sub-vectors of a code, and centroids of each.
PARTS, CENTROIDS = 32, 256
#: Vectors and queries that meet in one task at a time.
BLOCK_VECTORS, BLOCK_QUERIES = 2048, 512
#: Queries whose tables a task holds at a time.
AT_ONCE = 512
#: Best of a query, in a block and over all, that go on to be scored exactly.
RERANKED = 128


@dataclass(frozen=True)
class Model:
    """Coarse centroids (cells, d) and codebooks (parts, centroids, d / parts)."""

    cells: Any
    books: Any

    def pad(self, x):
        import numpy as np

        d = self.books.shape[0] * self.books.shape[2]
        return x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1])))

    def assign(self, x):
        return nearest(x, self.cells)

    def code(self, x):
        """Cell, residual length and codes of each vector."""
        import numpy as np

        cell = self.assign(x)
        rest = x - self.cells[cell]
        size = np.linalg.norm(rest, axis=1)
        unit = self.pad(rest / np.maximum(size, 1e-30)[:, None])
        parts, _, w = self.books.shape
        codes = np.stack([nearest(unit[:, j * w : (j + 1) * w], self.books[j]) for j in range(parts)], 1)
        return cell, size.astype(np.float32), codes.astype(np.uint8)

    def tables(self, q):
        """Inner products of each query's sub-vectors with every sub-centroid."""
        import numpy as np

        parts, _, w = self.books.shape
        return np.einsum("qpw,pcw->qpc", self.pad(q).reshape(len(q), parts, w), self.books)


def nearest(x, centres):
    """Index of the nearest centre (Euclidean) of each row."""
    import numpy as np

    half = (centres * centres).sum(1) / 2
    out = np.empty(len(x), np.int64)
    for s in range(0, len(x), 8192):
        out[s : s + 8192] = (x[s : s + 8192] @ centres.T - half).argmax(1)
    return out


def k_means(x, k: int, rounds: int, seed: int):
    import numpy as np

    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(n)
        centres[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def fit(sample, cells: int, parts: int = PARTS, seed: int = 7) -> Model:
    import numpy as np

    sample = np.ascontiguousarray(sample, np.float32)
    centres = k_means(sample, cells, 10, seed)
    rest = sample - centres[nearest(sample, centres)]
    size = np.linalg.norm(rest, axis=1)
    unit = rest[size > 1e-12] / size[size > 1e-12, None]
    if not len(unit):
        unit = np.zeros((1, sample.shape[1]), np.float32)
    d = sample.shape[1]
    parts = min(parts, d)
    w = -(-d // parts)
    unit = np.pad(unit, ((0, 0), (0, parts * w - d)))[:16_384]
    books = [k_means(unit[:, j * w : (j + 1) * w], CENTROIDS, 6, seed + j) for j in range(parts)]
    return Model(centres, np.stack([np.pad(b, ((0, CENTROIDS - len(b)), (0, 0)), constant_values=1e6) for b in books]).astype(np.float32))


def probes_for(model: Model, sample, k: int, recall: float, asked: int = 256) -> int:
    """Cells to visit so that ``recall`` of the sample's own k nearest lie in
    them.  Neighbours in all the data are nearer than those in a sample, so the
    number errs on the side of more."""
    import numpy as np

    x = np.ascontiguousarray(sample, np.float32)
    q = x[np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)]
    cell, near = model.assign(x), q @ x.T
    k = min(k + 1, len(x))  # one of them is the query
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ model.cells.T), 1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    reached = np.sort(np.take_along_axis(place, cell[best], 1).ravel())
    return int(reached[min(len(reached) - 1, math.ceil(recall * len(reached)))]) + 1


def usable(e: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(e, lambda x: x != 0)


def _matrix(column):
    import numpy as np

    flat = column.flatten() if not hasattr(column, "combine_chunks") else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32)


def _index(vectors: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                cell, size, codes = model.code(_matrix(b.column(1)))
                flat, w = codes.tobytes(), codes.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), pa.array(size), pa.array([flat[i * w : i * w + w] for i in range(len(cell))], pa.binary())], ["cell", "id", "size", "codes"])

    return vectors.select("id", "e").mapInArrow(run, "cell int, id long, size float, codes binary")


def _probes(queries: DataFrame, model: Model, counts: list[int], group: list[int], probes: int) -> DataFrame:
    """A row for each query and group of cells that it visits: the cells, and
    their inner products with the query."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, of = np.array(counts), np.array(group)
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column(1))
            base = q @ model.cells.T
            base[:, n == 0] = -np.inf
            order = np.argsort(-base, 1, kind="stable")
            visit = np.zeros(base.shape, bool)
            np.put_along_axis(visit, order, (np.arange(len(n)) < probes) & (n[order] > 0), 1)
            out = ([], [], [], [], [])
            ids = b.column(0).to_pylist()
            for i in range(len(q)):
                cells = np.flatnonzero(visit[i])
                for g in np.unique(of[cells]):
                    mine = cells[of[cells] == g]
                    for o, v in zip(out, (int(g), ids[i], mine, base[i, mine], q[i].tobytes())):
                        o.append(v)
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], ["g", "q", "cells", "base", "e"])

    return queries.select("id", "e").mapInArrow(run, "g int, q long, cells array<int>, base array<float>, e binary")


def _best(ids, scores, n: int):
    """Positions of the n best, ties to smaller ids."""
    import numpy as np

    if len(ids) > n:
        low = np.partition(scores, len(scores) - n)[len(scores) - n]
        at = np.flatnonzero(scores >= low)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at]))[:n]]


def added(tables, codes, rows):
    """Sums over the parts of table entries (part, code, query) for each vector
    with ``codes`` (part, vector) and each of the queries ``rows``.

    Entries of all queries are added as whole rows unless few of them ask: a
    single entry costs about eight times its share of a row."""
    import numpy as np

    if len(rows) * 8 >= tables.shape[2]:
        total, part = tables[0][codes[0]], np.empty((codes.shape[1], tables.shape[2]), np.float32)
        for j in range(1, len(codes)):
            total += np.take(tables[j], codes[j], axis=0, out=part)
        return total[:, rows]
    total = tables[0][codes[0][:, None], rows]
    for j in range(1, len(codes)):
        total += tables[j][codes[j][:, None], rows]
    return total


def _scan(codes: DataFrame, probes: DataFrame, model: Model, keep: int) -> DataFrame:
    """Best of each query in each block of codes that it meets, by the tables."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        out = ([], [], [])
        if left.num_rows and right.num_rows:
            left = left.sort_by([("cell", "ascending"), ("id", "ascending")])
            ids, size, cell = (left.column(c).to_numpy() for c in ("id", "size", "cell"))
            at = np.ascontiguousarray(np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1).T.astype(np.int64))
            cut = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            span = {int(cell[s]): (s, e) for s, e in zip(np.r_[0, cut], np.r_[cut, len(cell)])}
            q = np.frombuffer(b"".join(right.column("e").to_pylist()), np.float32).reshape(right.num_rows, -1)
            names, visits, base = right.column("q").to_pylist(), right.column("cells").to_pylist(), right.column("base").to_pylist()
            for s in range(0, len(q), AT_ONCE):
                # By part and code: the entries of all queries lie side by side.
                tables = np.ascontiguousarray(model.tables(q[s : s + AT_ONCE]).transpose(1, 2, 0))
                near = np.full((len(ids), tables.shape[2]), -np.inf, np.float32)
                by: dict[int, list] = {}
                for i in range(tables.shape[2]):
                    for c, b in zip(visits[s + i], base[s + i]):
                        by.setdefault(c, []).append((i, b))
                for c, who in by.items():
                    if c in span:
                        lo, hi = span[c]
                        rows, b = np.array([w[0] for w in who]), np.array([w[1] for w in who], np.float32)
                        near[lo:hi, rows] = b + added(tables, at[:, lo:hi], rows) * size[lo:hi, None]
                for i, row in enumerate(np.ascontiguousarray(near.T)):
                    best = _best(ids, row, keep)
                    best = best[row[best] > -np.inf]
                    out[0].append(names[s + i])
                    out[1].append(ids[best])
                    out[2].append(row[best])
        return pa.table({"q": pa.array(out[0], pa.int64()), "ids": pa.array(out[1], pa.list_(pa.int64())), "scores": pa.array(out[2], pa.list_(pa.float32()))})

    keys = ["g", "bx", "bq"]
    return codes.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(run, "q long, ids array<long>, scores array<float>")


def cell_groups(counts: list[int], rows: int) -> list[int]:
    """Neighbouring cells packed into groups of about ``rows`` vectors."""
    out, g, held = [], 0, 0
    for n in counts:
        if held and held + n > rows:
            g, held = g + 1, 0
        out.append(g)
        held += n
    return out


def _merge(found: DataFrame, keep: int) -> DataFrame:
    """(q, id) of the ``keep`` best of each query over all its blocks."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        at, ids, scores = None, None, None
        for b in batches:
            out = ([], [])
            for q, i, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                i, s = i.values.to_numpy(), s.values.to_numpy()
                if q != at:
                    if at is not None:
                        out[0].append(np.full(len(ids), at))
                        out[1].append(ids)
                    at, ids, scores = q, i, s
                else:
                    i, s = np.concatenate([ids, i]), np.concatenate([scores, s])
                    best = _best(i, s, keep)
                    ids, scores = i[best], s[best]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["q", "id"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), at)), pa.array(ids)], ["q", "id"])

    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return found.repartition(tasks, "q").sortWithinPartitions("q").mapInArrow(rows, "q long, id long")


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
    reranked: int = RERANKED,
    sample: tuple[int, int] = SAMPLE,
    report: dict | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for
    which ``is_query`` (over ``id_col``), among all other rows.

    ``report`` is told the vectors, the cells, the cells that a query visits and
    the share of all vectors whose codes it meets there."""
    import numpy as np

    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).alias("e")).where(F.col(id_col).isNotNull() & usable(F.col("e")))
    rows = rows.select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), "e")
    lengths = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    rows = rows.where(F.size("e") == lengths.d)
    # Equal vectors: -0.0 equals 0.0; two 64-bit hashes name a vector.
    same = F.transform("e", lambda x: x.cast("double") + F.lit(0.0))
    named, _ = written(rows.groupBy("id", F.xxhash64(same).alias("h1"), F.xxhash64(F.lit("b"), same).alias("h2")).agg(F.first("e").alias("e"), F.max("asks").alias("asks")), "vectors")
    order = Window.partitionBy("h1", "h2").orderBy("id")
    salted = Window.partitionBy("h1", "h2", "salt").orderBy("id")
    few = named.select("h1", "h2", "id", F.pmod(F.xxhash64("id"), F.lit(16)).alias("salt")).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    few = few.select("h1", "h2", "id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    classes, _ = written(few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "classes")
    entries = named.join(classes.select("h1", "h2", "rep"), (named.id == classes.rep) & (named.h1 == classes.h1) & (named.h2 == classes.h2)).select("id", "e", named.h1, named.h2)
    asking = named.where("asks").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by("e", "id").alias("e"))
    n = classes.count()
    if n == 0:
        return empty

    cells = max(1, min(MOST_CELLS, FINENESS * math.isqrt(n)))
    size = min(max(A_CELL * cells, sample[0]), sample[1])
    part = min(1.0, size / n)
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(part * (1 << 20))
    picked = entries.where(drawn).select("e").limit(2 * size).toArrow()
    if not picked.num_rows:
        picked = entries.select("e").limit(size).toArrow()
    drawn = _matrix(picked.column("e"))
    model = fit(drawn, min(cells, max(1, len(drawn) // 4)))
    probes = probes_for(model, drawn, k, recall)
    index, _ = written(_index(entries, model), "codes")
    per_cell = {r.cell: r.n for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # as many as cells
    counts = [per_cell.get(c, 0) for c in range(len(model.cells))]
    group = cell_groups(counts, BLOCK_VECTORS)
    visits, _ = written(_probes(asking, model, counts, group, probes), "probes")
    if report is not None:
        met = visits.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("m")).collect()  # as many as cells
        share = sum(r.m * counts[r.cell] for r in met) / max(1, sum(counts) * asking.count())
        report.update(vectors=n, cells=len(counts), probes=probes, visited_share=share)
    per_visit = {r.g: r.n for r in visits.groupBy("g").agg(F.count("*").alias("n")).collect()}
    held = [0] * (group[-1] + 1)
    for c, g in enumerate(group):
        held[g] += counts[c]
    blocks = [(g, max(1, -(-v // BLOCK_VECTORS)), max(1, -(-per_visit.get(g, 0) // BLOCK_QUERIES))) for g, v in enumerate(held)]
    grid = spark.createDataFrame(blocks, "g int, nx int, nq int")
    grid = F.broadcast(grid)  # MOST_CELLS rows at most
    of = F.broadcast(spark.createDataFrame(list(enumerate(group)), "cell int, g int"))  # so is this
    left = index.join(of, "cell").join(grid, "g").select("g", F.pmod(F.xxhash64("id"), "nx").cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"), "cell", "id", "size", "codes")
    right = visits.join(grid, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), F.pmod(F.xxhash64("q"), "nq").cast("int").alias("bq"), "q", "cells", "base", "e")
    best_n = max(reranked, 2 * k)
    found = _merge(_scan(left, right, model, best_n), best_n)

    scored = found.join(entries.select(F.col("id").alias("_i"), F.col("e").alias("x")), F.col("id") == F.col("_i")).join(asking.select(F.col("id").alias("_q"), F.col("e").alias("y")), F.col("q") == F.col("_q"))
    scored = scored.select("q", "id", inner_product(F.col("y"), F.col("x")).alias("score"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    wide = best.join(classes.select("rep", "ids"), best.id == classes.rep).select("q", "score", F.explode("ids").alias("vec_id"))
    wide = wide.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).select("q", "score", "vec_id")
    # Back from distinct query vectors to the rows that asked.
    names = asking.select("h1", "h2", F.col("id").alias("_rep"))
    asked = named.where("asks").select(F.col("id").alias("query_id"), "h1", "h2").join(names, ["h1", "h2"]).select("query_id", "_rep")
    mine = wide.join(asked, wide.q == asked._rep).where("vec_id <> query_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
