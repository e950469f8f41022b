"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents.

Results of odd inputs, in every stage: a row is itself, whatever its id; rows
without an id, and different rows under one id, are decided on one by one, by a
number that the stage gives each row.  Nulls in any column are kept.  An empty
table gives an empty one.  Other columns, whatever they are called, go through.
Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import exact_dedup, langid, mixing, simhash
from chronolith.llm._common import table, written
from chronolith.llm.queries import bpe_digests, quality_weights, vocabulary_source


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents have not."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number for each row, which all readings see alike, and
    the name of its column: a 64-bit hash of the row's file and its place there.

    Documents that are not read from files are written first."""
    key = _free(docs, "_row")
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(key)
    try:
        return docs.select("*", place), key
    except AnalysisException:
        return written(docs, "documents")[0].select("*", place), key


def _first(rows: DataFrame, key: str, by: str, size: Column | None = None) -> DataFrame:
    """As doc_id, the number of one row for each value of ``by``: of the largest
    ``size``, then the smallest id, no id being the largest, then the least number."""
    order = F.struct((F.lit(0) if size is None else -size).alias("s"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col(key).alias("k"))
    return rows.groupBy(by).agg(F.min(order).alias("_f")).select(F.col("_f.k").alias("doc_id"))


def _only(docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The keyed documents whose numbers an operator gave as doc_id, without the numbers."""
    return docs.join(found.select(F.col("doc_id").alias(key)), key, "left_semi").drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any text in letters, to which no language can be given,
    go: null, empty and white-space-only texts, numbers and signs alone."""
    samples, (rows, key) = langid.learn(docs, usable=~langid.held_out()), _keyed(docs)
    known = langid.identify(rows, samples, key).where(F.col("lang_pred") != langid.UNKNOWN)
    return _only(rows, key, known).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts stays: the longest, then that with the
    smallest id, a null id being the largest; of rows that tie in both, one.
    Different texts under one id all stay."""
    rows, key = _keyed(docs)
    classes = exact_dedup.exact_duplicates(rows, key).select(F.col("doc_id").alias("_key"), "text_sha256")
    known = rows.select(F.col(key).alias("_key"), F.col("doc_id").alias("_id"), F.coalesce(F.length("text"), F.lit(0)).alias("_size"))
    return _only(rows, key, _first(classes.join(known, "_key"), "_key", "text_sha256", F.col("_size"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, one row with the smallest id stays, a null id being the
    largest.  All wordless texts have one fingerprint, so one of them stays."""
    rows, key = _keyed(docs)
    linked = simhash.near_duplicates(rows, key).select(F.col("doc_id").alias("_key"), "component_id")
    known = rows.select(F.col(key).alias("_key"), F.col("doc_id").alias("_id"))
    return _only(rows, key, _first(linked.join(known, "_key"), "_key", "component_id")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each row by itself; wordless ones
    are never taken, a null source is a source of its own."""
    rows, key = _keyed(docs)
    mixed = mixing.mix(rows, quality_weights(table(spark, sf_dir, "labels")), keep=(key,))
    copies, copy = _free(rows, "_copies"), _free(rows, "_copy")
    taken = mixed.where("copies > 0").select(key, F.col("copies").alias(copies))
    each = F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)
    return rows.join(taken, key).select(*docs.columns, each).drop(copy)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: number of ids, digests of the ids and of what they
    decode to.  A null text counts as empty; ids and repeated rows are kept."""
    return bpe_digests(docs, *vocabulary_source())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Language ID, fingerprints and BPE have no SQL form; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return docs
