"""Operation files: records of nine bytes, [operation][key, 64 bits little-endian]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
CODES = {"I": 0, "U": 1, "D": 2}
RECORD = 9


def _swap(hex16: Column) -> Column:
    """Sixteen hexadecimal digits with their eight bytes in reverse order."""
    return F.concat(*(F.substring(hex16, 15 - 2 * i, 2) for i in range(8)))


def encode(ops: DataFrame, segment: str = "segment", order: str = "seq") -> DataFrame:
    """(segment, content) of operations (op, key), in order within a segment."""
    code = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))[F.col("op")]
    record = F.concat(F.lpad(F.hex(code.cast("long")), 2, "0"), _swap(F.lpad(F.hex(F.col("key")), 16, "0")))
    g = ops.groupBy(F.col(segment).alias("segment")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), record.alias("r")))).alias("x"))
    return g.select("segment", F.unhex(F.array_join(F.transform("x", lambda r: r["r"]), "")).alias("content"))


def decode(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(path, pos, op, key) of each record; an incomplete last record is left out."""
    # Cut into records before they become rows, so that no row carries its file.
    records = F.regexp_extract_all(F.hex(F.col(content)), F.lit(f"([0-9A-F]{{{2 * RECORD}}})"), 1)
    rows = files.select(F.col(name).alias("path"), F.posexplode(records).alias("pos", "h")).withColumn("pos", F.col("pos").cast("long"))
    names = F.element_at(F.array(*(F.lit(k) for k in CODES)), F.conv(F.substring("h", 1, 2), 16, 10).cast("int") + 1)
    return rows.select("path", "pos", names.alias("op"), F.conv(_swap(F.substring("h", 3, 16)), 16, 10).cast("long").alias("key"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(path))


def generate(spark: SparkSession, population: int, blocks: int, per_block: int, seed: int = 1) -> DataFrame:
    """(seq, op, key): an initial population, then blocks of inserts of new keys
    and of updates and deletes of hash-drawn old ones, shuffled within a block."""
    first = spark.range(population).select(F.col("id").alias("seq"), F.lit("I").alias("op"), (F.col("id") + 1).alias("key"))
    x = spark.range(blocks * per_block)
    block = F.floor(F.col("id") / per_block)
    kind = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(3))
    old = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id")), F.lit(population)) + 1
    rest = x.select(
        block.alias("block"),
        F.xxhash64(F.lit(seed + 2), F.col("id")).alias("turn"),
        F.element_at(F.array(F.lit("I"), F.lit("U"), F.lit("D")), (kind + 1).cast("int")).alias("op"),
        F.when(kind == 0, F.lit(population + 1) + F.col("id")).otherwise(old).alias("key"),
    )
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("block").orderBy("turn"))
    return first.unionByName(rest.select((F.lit(population) + F.col("block") * per_block + place - 1).alias("seq"), "op", "key"))
