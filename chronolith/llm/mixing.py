"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets share the total size by weight; none may exceed ``MOST`` times its
source's size, and what it would have had over goes to the others by weight.
A source first gives as many complete epochs as its target holds; the rest is
a weighted sample without replacement: every document draws an exponential key
with its quality weight as the rate, keys are sorted within the source, and
documents are taken for as long as the sum of sizes stays within the rest.  Of
the documents left, the one whose size fits the gap best fills it, if that
brings the source nearer to its target.

The prefix sums have two levels: each source is cut into ``SLICES`` ranges of
the key, whose sums are prefix-summed, so a source with a third of all rows is
sorted in that many parts.  All of it is DataFrame functions.

Result of odd inputs: null and wordless texts have size 0 and take 0; a null
source is a source of its own, in last place; a source without words has
target 0; a null id draws the key of the empty string; rows that agree in
every column used are interchangeable; missing, null or non-positive quality
weights count as 1; an empty table gives an empty result; other columns of the
documents are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD

MOST = 3
WEIGHTS = (1, 2, 3)
SLICES = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column) -> Column:
    """A uniform draw in (0, 1) from 48 bits of the key's MD5: the same in every run."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a
    source, so the windows below sort no more rows than there are sources.

    With sources in order of limit over weight, those before the first whose
    fair share fits below its limit are at their limits."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    n = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), n + 1).cast("double")).withColumn("most", (F.lit(most) * F.col("source_size")).cast("double"))
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(whole).cast("double")).withColumn("all_weight", F.sum("weight").over(whole))
    s = s.withColumn("gone", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("gone_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("gone")) / (F.col("all_weight") - F.col("gone_weight")))
    s = s.withColumn("share", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(whole)["level"])
    return s.select("source", "source_size", F.least("most", F.coalesce(F.col("weight") * F.col("share"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, slices: int = SLICES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies
    (how often the mix takes it), taken (size times copies), and ``keep``.

    ``quality`` has (doc_id, weight), where the largest weight of an id holds;
    sizes are counted before the join, so no text is shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), *keep)
    if quality is None:
        w = F.lit(1.0)
    else:
        best = quality.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("weight").cast("double")).alias("_weight"))
        rows = rows.join(best, rows.doc_id == best._id, "left")
        w = F.when(F.col("_weight") > 0, F.col("_weight")).otherwise(F.lit(1.0))
    rows = rows.select("doc_id", "source", "size", (-F.log(draw(F.col("doc_id"))) / w).alias("_key"), *keep)
    # Keys in slices of about equal probability; any increasing function would do.
    rows = rows.withColumn("_slice", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * slices), F.lit(slices - 1)).cast("int"))
    parts = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_part"))
    goals = targets(parts.groupBy("source").agg(F.sum("_part").alias("source_size")), weights, most)
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_part").over(earlier), F.lit(0)))
    parts = parts.join(goals.withColumnRenamed("source", "_s"), F.expr("source <=> _s")).drop("_s")
    parts = parts.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    parts = parts.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    # At most slices x sources rows, whatever the number of documents.
    rows = rows.join(parts.select(F.col("source").alias("_s"), F.col("_slice").alias("_l"), "source_size", "target", "_before", "_epochs", "_rest"), F.expr("source <=> _s AND _slice = _l"))
    within = Window.partitionBy("source", "_slice").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size")
    upto = F.col("_before") + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("size")
    # Used three times below; the shuffle under the windows is planned once and reused.
    rows = rows.withColumn("_upto", upto).withColumn("_nth", F.row_number().over(within)).drop("_s", "_l")
    inside = F.col("_upto") <= F.col("_rest")
    # One row a source: what the prefix leaves open, and the document that fills it best.
    reached = rows.groupBy("source").agg(F.coalesce(F.max(F.when(inside, F.col("_upto"))), F.lit(0)).alias("_reached")).withColumnRenamed("source", "_s")
    left = rows.where(~inside & (F.col("size") > 0)).join(reached, F.expr("source <=> _s")).withColumn("_gap", F.col("_rest") - F.col("_reached"))
    left = left.where(F.abs(F.col("_gap") - F.col("size")) < F.col("_gap"))
    place = F.struct(F.abs(F.col("_gap") - F.col("size")).alias("d"), "_key", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), "size", "_slice", "_nth")
    fill = left.groupBy(F.col("source").alias("_s")).agg(F.min(place).alias("_f")).select("_s", F.col("_f._slice").alias("_fs"), F.col("_f._nth").alias("_fn"))
    rows = rows.join(fill, F.expr("source <=> _s AND _slice = _fs AND _nth = _fn"), "left")
    more = inside | F.col("_fn").isNotNull()
    copies = F.when(F.col("size") > 0, F.col("_epochs") + F.when(more, 1).otherwise(0)).otherwise(F.lit(0)).cast("int")
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *keep)
